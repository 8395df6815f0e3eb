"""Library-only operators: listings, lookups, inference logs, verdicts."""

from pyspark.ml.linalg import Vectors

from tracewise.operators import classify, convert, memory, validate


def test_chain_listing_and_lookup(spark):
    chains = spark.createDataFrame([("a", "math", "q" * 120), ("b", "code", "short")], "chain_id string, domain string, query string")
    steps = spark.createDataFrame([("a", 0, True), ("a", 1, False)], "chain_id string, idx long, is_correct boolean")
    rows = {r.chain_id: r for r in validate.chain_listing(steps, chains, query_chars=100).collect()}
    assert validate.chain_listing(steps, chains, domain="math").first().query == "q" * 120
    assert rows["a"].query == "q" * 100 + "..." and rows["a"].num_steps == 2 and rows["a"].has_errors
    assert rows["b"].num_steps == 0 and not rows["b"].has_errors
    assert validate.chain_listing(steps, chains, domain="code", limit=5).count() == 1
    assert validate.lookup_chain(chains, "b").first().domain == "code"


def test_inference_logs(spark):
    log = spark.createDataFrame([
        ("gpt4", "q1", "r", ["s1", "s2"], 1.0, 10, None),
        ("gpt4", "q2", "r", ["s1"], 3.0, 10, "timeout"),
        ("llama", "q1", "r", ["a", "b", "c"], 2.0, 5, ""),
    ], "model_type string, query string, response string, reasoning_steps array<string>, latency double, "
       "tokens_used int, error string")
    ch = {r.query_id: r for r in convert.inference_log_to_chains(log).collect()}
    assert set(ch) == {"q1_gpt4", "q1_llama"} and ch["q1_gpt4"].query == "q1"
    assert ch["q1_llama"].dependency_graph.edges == [[0, 1], [1, 2]]
    m = {r.model_type: r for r in convert.inference_log_metrics(log).collect()}
    assert (m["gpt4"].calls, m["gpt4"].errors, m["gpt4"].avg_latency) == (2, 1, 2.0)


def test_verdict(spark):
    pred = spark.createDataFrame([("x", Vectors.dense([0.2, 0.5, 0.3])), ("y", Vectors.dense([0.9, 0.05, 0.05]))],
                                 ["chain_id", "probability"])
    mapping = spark.createDataFrame([("b", "Model B"), ("c", "Model C")], "label_name string, display string")
    v = {r.chain_id: r.verdict for r in classify.verdict(pred, ["a", "b", "c"], mapping).collect()}
    assert v == {"x": "Model B", "y": "Model B"}   # unmapped 'a' is skipped; the b/c tie goes to the first class


def test_mention_history(spark):
    ts = spark.createDataFrame([(1, 1, 0, "x = 3"), (1, 0, 0, "x = 5")], "conv_id long, turn long, step_idx long, text string")
    h = memory.mention_history(memory.extract_entities(ts), 1, "x").collect()
    assert [r.value for r in h] == ["5.0", "3.0"]


def test_concat_steps(spark):
    from tracewise.operators.fingerprint import concat_steps
    s = spark.createDataFrame([("c", 1, "b"), ("c", 0, "a")], "chain_id string, idx long, text string")
    assert concat_steps(s).first().text == "a b"
