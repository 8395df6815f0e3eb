"""Golden vectors worked out by hand from the reference's module demos
(SURVEY §5) plus invariants between two formulations of the same metric."""

import pytest
from pyspark.sql import functions as F

from tracewise.operators import (compare, consensus, convert, evaluate, fingerprint, graph, memory, patterns,
                                 propagate, risk)
from tracewise.functions.ranking import grouped_position, k_smallest_distinct
from tracewise.operators import split as S


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- consensus (M2–M6) --------------------------------------------------------

VOTES = {"gpt4": [True, True, False, True, True], "gemini": [True, True, False, False, True],
         "llama": [True, True, True, True, True]}


@pytest.fixture()
def votes(spark):
    data = [("c1", i, m, p, o) for o, (m, ps) in enumerate(VOTES.items()) for i, p in enumerate(ps)]
    return spark.createDataFrame(data, "chain_id string, idx long, model_type string, pred boolean, model_order int")


def test_majority_vote(votes):
    r = consensus.majority_vote(votes).orderBy("idx")
    assert [x.pred for x in r.collect()] == [True, True, False, True, True]
    assert [round(x.agreement, 4) for x in r.collect()] == [1.0, 1.0, 0.6667, 0.6667, 1.0]
    c = consensus.chain_consensus(consensus.majority_vote(votes)).first()
    assert round(c.consensus_confidence, 4) == 0.8667 and c.consensus_exists  # T3: 0.5 threshold always agrees


def test_weighted_unanimous_expert(spark, votes):
    w = spark.createDataFrame([("gpt4", 1.5), ("gemini", 1.0), ("llama", 0.5)], "model_type string, weight double")
    wv = consensus.weighted_vote(votes, w).orderBy("idx").collect()
    assert [x.pred for x in wv] == [True, True, False, True, True]
    assert [round(x.agreement, 4) for x in wv] == [1.0, 1.0, 0.8333, 0.6667, 1.0]
    un = consensus.unanimous_vote(votes).orderBy("idx").collect()
    assert [x.pred for x in un] == [True, True, False, False, True]
    ex = consensus.expert_vote(votes, w).orderBy("idx").collect()
    assert [x.pred for x in ex] == [True, True, False, True, True]
    # a stricter threshold exposes disagreements
    c = consensus.chain_consensus(consensus.majority_vote(votes), 0.8).first()
    assert not c.consensus_exists and c.num_disagreements == 2
    pts = consensus.disagreement_points(consensus.majority_vote(votes), 0.8)
    assert sorted(r.idx for r in pts.collect()) == [2, 3]


def test_tie_is_false(spark):
    v = spark.createDataFrame([("c", 0, "a", True), ("c", 0, "b", False)], "chain_id string, idx long, model_type string, pred boolean")
    assert consensus.majority_vote(v).first().pred is False


def test_input_check_rejects_unequal_lengths(spark):
    v = spark.createDataFrame([("c", 0, "a", True), ("c", 1, "a", True), ("c", 0, "b", False), ("d", 0, "a", True)],
                              "chain_id string, idx long, model_type string, pred boolean")
    ok, bad = consensus.check_inputs(v)
    assert [r.chain_id for r in bad.collect()] == ["c"]
    assert ok.count() == 1


# --- controller (R10–R13) -----------------------------------------------------

def test_interventions(spark):
    s = spark.createDataFrame([("c", i, r) for i, r in enumerate([0.2, 0.5, 0.8, 0.3])],
                              "chain_id string, idx long, risk double")
    iv = risk.interventions(s).orderBy("step_id").collect()
    assert [(x.step_id, x.intervention_type) for x in iv] == [(1, "WARNING"), (2, "CORRECTION"), (3, "WARNING")]
    st = risk.intervention_stats(risk.interventions(s)).first()
    assert (st.total_interventions, st.warnings, st.corrections) == (3, 2, 1)
    assert iv[0].warning_message == "CAUTION: Step 1 shows moderate vulnerability (risk: 0.50)"
    assert iv[1].correction_suggestion.startswith("Step 2: Verify that all dependencies")
    # corrections disabled -> high risk becomes a warning
    iv2 = risk.interventions(s, enable_corrections=False).collect()
    assert {x.intervention_type for x in iv2} == {"WARNING"}


def test_replay_closed_form_equals_expanded(spark):
    data = [(c, i, ok, r) for c, seq in enumerate([[0.1, 0.4, 0.9], [0.0, 0.35], [0.5], [0.2, 0.1, 0.6, 0.3]])
            for i, r in enumerate(seq) for ok in [i != 1]]
    s = spark.createDataFrame(data, "chain_id long, idx long, is_correct boolean, risk double")
    closed = {r.chain_id: r.iv_0 for r in risk.chain_replay(s, [0.3]).collect()}
    expanded = {r.chain_id: r.interventions for r in risk.replay_expanded(s, 0.3).collect()}
    assert closed == expanded


def test_lookahead(spark):
    s = spark.createDataFrame([("c", i, ok) for i, ok in enumerate([True, True, False, True, False])],
                              "chain_id string, idx long, is_correct boolean")
    r = risk.lookahead_labels(s).orderBy("idx").collect()
    assert [x.steps_until_error for x in r] == [2, 1, 2, 1, -1]
    assert [x.future_error_count for x in r] == [2, 2, 1, 1, 0]
    assert [x.risk_level for x in r] == ["MEDIUM", "HIGH", "MEDIUM", "HIGH", "LOW"]


# --- cross-model and patterns (X1–X4, P3–P9) -----------------------------------

def _demo_steps(spark):
    chains = {("gpt4", "g1"): [2], ("gpt4", "g2"): [], ("gemini", "m1"): [2, 3], ("gemini", "m2"): [1]}
    data = [(cid, i, "math", m, i not in errs, None if i not in errs else "logical")
            for (m, cid), errs in chains.items() for i in range(5)]
    return spark.createDataFrame(data, "chain_id string, idx long, domain string, model_type string, is_correct boolean, error_type string")


def test_cross_model(spark):
    st = _demo_steps(spark)
    rates = {r.model_type: round(r.error_rate, 6) for r in compare.error_rate_by_model(st).collect()}
    assert rates == {"gpt4": 0.1, "gemini": 0.3}
    sim = compare.model_similarity(st).first()
    assert round(sim.similarity, 6) == 0.8


def test_pattern_store_and_profile(spark):
    occ = spark.createDataFrame([
        ("gpt4_math_factual_001", "gpt4", "math", "factual", "Incorrect calculation", "2 + 2 = 5", 0.8, (0, 0)),
        ("gemini_code_syntax_001", "gemini", "code", "syntax", "Missing semicolon", "print('hello')", 0.6, (1, 0)),
        ("gpt4_math_factual_001", "gpt4", "math", "factual", "Incorrect calculation", "2 + 2 = 5", 0.8, (2, 0)),
    ], "pattern_id string, model_type string, domain string, hallucination_type string, description string, "
       "example string, severity double, first_seen struct<c:int,i:int>")
    store = patterns.pattern_store(occ)
    freq = {r.pattern_id: r.frequency for r in store.collect()}
    assert freq == {"gpt4_math_factual_001": 2, "gemini_code_syntax_001": 1}
    prof = patterns.vulnerability_profile(store, store.select("model_type").distinct()).filter("model_type = 'gpt4'").first()
    assert prof.vulnerability_score == 0.8 and prof.most_common_type == "factual"
    assert patterns.model_stats(store).filter("model_type = 'gpt4'").first().avg_severity == 0.8
    probe = store.filter("pattern_id = 'gpt4_math_factual_001'")
    assert patterns.similar_patterns(store, probe, 0.7).count() == 0          # 0.3 * (1 - 0.2) = 0.24
    sim = patterns.similar_patterns(store, probe, 0.2).first()
    assert round(sim.similarity, 6) == 0.24


# --- conversation memory (H1–H5) -------------------------------------------------

def test_memory_demo(spark):
    ts = spark.createDataFrame([
        (1, 0, 0, "Let x = 5"), (1, 0, 1, "Then 2x = 10"),
        (1, 1, 0, "Since x = 5, we know x^2 = 25"),
        (1, 2, 0, "Now x = 3, so x + 2 = 5"),
    ], "conv_id long, turn long, step_idx long, text string")
    ec = memory.entity_conflicts(memory.extract_entities(ts)).orderBy("name").collect()
    assert [(r.turn, r.name, r.current_value, r.previous_value) for r in ec] == [(2, "2", "5.0", "25.0"), (2, "x", "3.0", "5.0")]


def test_claims_check_then_add(spark):
    ts = spark.createDataFrame([
        (1, 0, 0, "The sky is blue"), (1, 0, 1, "sky is green"),   # same turn: not a conflict
        (1, 1, 0, "Sky IS red"), (1, 2, 0, "sky equals blue"),
    ], "conv_id long, turn long, step_idx long, text string")
    cc = memory.claim_conflicts(memory.extract_claims(ts)).orderBy("turn").collect()
    assert [(r.turn, r.subject, r.current_value, r.previous_value) for r in cc] == [(2, "sky", "blue", "green")]


# --- graphs and propagation (G2–G6, E2–E4) -----------------------------------

def test_topology_chain(spark):
    nodes = spark.createDataFrame([("c", i) for i in range(3)], "chain_id string, node long")
    edges = spark.createDataFrame([("c", 0, 1), ("c", 1, 2)], "chain_id string, src long, dst long")
    d = graph.degrees(nodes, edges).orderBy("node").collect()
    assert [(r.in_deg, r.out_deg) for r in d] == [(0, 1), (1, 1), (1, 0)]
    assert [r.clustering for r in graph.clustering(nodes, edges).orderBy("node").collect()] == [0.0, 0.0, 0.0]
    assert [r.path_length for r in graph.root_distance(nodes, edges).orderBy("node").collect()] == [0, 1, 2]
    assert [r.betweenness for r in graph.betweenness(nodes, edges).orderBy("node").collect()] == [0.0, 0.5, 0.0]
    lp = graph.longest_paths(nodes, edges).first()
    assert lp.max_depth == 2 and lp.is_dag


def test_triangles_and_cycles(spark):
    nodes = spark.createDataFrame([("t", i) for i in range(4)], "chain_id string, node long")
    edges = spark.createDataFrame([("t", 0, 1), ("t", 1, 2), ("t", 2, 0), ("t", 2, 3), ("t", 3, 3)],
                                  "chain_id string, src long, dst long")
    cl = {r.node: r.clustering for r in graph.clustering(nodes, edges).collect()}
    assert cl == {0: 1.0, 1: 1.0, 2: round(1 / 3, 6), 3: 0.0}
    lp = graph.longest_paths(nodes, edges).first()
    assert not lp.is_dag and lp.max_depth == 3


def test_propagation_demo(spark):
    steps = spark.createDataFrame([("c", 0, True, False), ("c", 1, False, True), ("c", 2, False, False)],
                                  "chain_id string, idx long, is_correct boolean, is_origin boolean")
    edges = spark.createDataFrame([("c", 0, 1), ("c", 1, 2)], "chain_id string, src long, dst long")
    pred = spark.createDataFrame([("c", 1)], "chain_id string, idx long")
    s = propagate.propagation_summary(steps, edges, pred).first()
    assert s.avg_contamination_ratio == 1.0 and s.avg_propagation_distance == 1.0
    assert s.num_intervention_points == 1 and s.origin_detection_rate == 1.0


# --- text (F2–F6, P2, C1, C5, C8, C9, P13) --------------------------------------

def test_fingerprint_demo(spark):
    texts = ["First, we need to identify the problem variables.", "Let x be the unknown value we're solving for.",
             "We can set up the equation: 2x + 5 = 13", "Subtracting 5 from both sides: 2x = 8",
             "Therefore, dividing by 2, we get x = 4"]
    st = spark.createDataFrame([("t", i, t, [i - 1] if i else []) for i, t in enumerate(texts)],
                               "chain_id string, idx long, text string, depends_on array<int>")
    fp = fingerprint.fingerprint(st).first()
    assert fp.num_steps == 5 and fp.avg_dependencies == 0.8 and fp.branching_factor == 0.0 and fp.graph_depth == 5
    assert fp.total_words == 45 and fp.vocab_richness == round(36 / 45, 6) and fp.total_sentences == 3
    assert fp.avg_word_length == 3.733333 and fp.technical_density == round(4 / 45, 6)
    assert fp.punctuation_density == round(5 / 212, 6) and fp.avg_step_length == 9.0
    assert fp.std_step_length == 1.095445 and fp.explanation_density == round(2 / 212, 6)
    assert fp.first_person_density == round(4 / 45, 6) and fp.passive_density == 0.0 and fp.hedge_density == 0.0
    assert fp.numbered_ratio == 0.0 and fp.math_density == 0.8


def test_response_parser(spark):
    resp = "Step 1: Subtract 5 from both sides: 2x = 8\nStep 2: Divide both sides by 2: x = 4\nFinal Answer: x = 4"
    df = spark.createDataFrame([(resp,), ("Step 1:\ndropped line\nStep 2: kept\n\ncontinued",), ("short\n\nthis paragraph is long enough",)],
                               "r string")
    out = [r.s for r in df.select(convert.parse_response("r").alias("s")).collect()]
    assert out[0] == ["Subtract 5 from both sides: 2x = 8", "Divide both sides by 2: x = 4", "x = 4"]
    assert out[1] == ["kept  continued"]
    assert out[2] == ["this paragraph is long enough"]


def test_math_conversion_traps(spark):
    raw = spark.createDataFrame([(
        "q1", ("p", "4", ["a", "b", "c", "d", "e"]),
        ([([(1,)],), ([(0,)],), ([],), ([(-1,)],), ([(-1,)],)],),
    )], "query_id string, question struct<problem:string,ground_truth_answer:string,pre_generated_steps:array<string>>, "
        "label struct<steps:array<struct<completions:array<struct<rating:int>>>>>")
    long = convert.to_long(convert.convert_math(raw)).orderBy("idx").collect()
    assert [r.step_id for r in long] == [0, 1, 3, 4]                     # T1: gap kept in step ids
    assert [r.is_correct for r in long] == [True, False, False, False]   # T2: neutral 0 is incorrect
    assert [r.is_origin for r in long] == [False, False, True, False]    # first -1 only
    assert [r.error_type for r in long] == [None, "logical", "logical", "logical"]


def test_medical_and_text_and_live(spark):
    med = spark.createDataFrame([("m", "q", "Aspirin helps. Sky is green. It hurts.", "aspirin helps pain. It hurts", "factual error")],
                                "id string, q string, a string, t string, c string")
    m = convert.to_long(convert.convert_medical(med, "id", "q", "a", "t", "c")).orderBy("idx").collect()
    assert [(r.is_correct, r.is_origin) for r in m] == [(True, False), (False, True), (True, False)]
    txt = spark.createDataFrame([("d", "1. first step 2. second\nthird")], "id string, t string")
    ch = convert.text_to_chain(txt, "t", "id").first()
    assert [s.text for s in ch.reasoning_steps] == ["first step", "second", "third"]
    one = spark.createDataFrame([("x", ["only"], "qa")], "id string, s array<string>, d string")
    c = convert.steps_to_chain(one, "s", "id", "d").first()
    assert c.dependency_graph.edges == [[0, 0]] and c.domain == "math"


def test_fenced_json(spark):
    df = spark.createDataFrame([('x ```json\n[{"text": "a"}, {"step": "b"}]\n``` y',)], "t string")
    assert df.select(convert.fenced_json_steps("t").alias("s")).first().s == ["a", "b"]


# --- evaluation and splits (D3, D4, S2, helpers) ---------------------------------

def test_auroc_matches_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    data = [(float(i % 7) / 7, int((i * 3) % 5 < 2)) for i in range(200)]
    df = spark.createDataFrame(data, "score double, y long").withColumn("g", F.lit(1))
    ours = evaluate.auroc(df, ["g"]).first().auroc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="yd", metricName="areaUnderROC")
    ref = ev.evaluate(df.withColumn("yd", F.col("y").cast("double")))
    assert abs(ours - ref) < 1e-6
    ap = evaluate.auprc(df, ["g"]).first().auprc
    assert 0 < ap <= 1


def test_grouped_position_is_exact(spark):
    from pyspark.sql import Window
    from tracewise.functions.common import hash_key
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id")).withColumn("k", hash_key("id"))
    ours = grouped_position(df, ["g"], "k", "id", bucket_bits=6)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1)
    j = ours.join(ref, ["g", "id"])
    assert j.filter(F.col("pos") != F.col("ref")).count() == 0


def test_split_is_exact_partition(spark):
    items = spark.range(1000).select(F.col("id").alias("chain_id"), (F.col("id") % 2 == 0).alias("has_error"),
                                     F.lit("math").alias("domain"))
    s = S.assign_splits(items, ["domain", "has_error"])
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 700, "val": 150, "test": 150}
    assert s.select("chain_id").distinct().count() == 1000


def test_k_smallest(spark):
    df = spark.createDataFrame([("p", str(v)) for v in [5, 3, 3, 9, 1, 7, 2]], "pid string, ex string")
    assert k_smallest_distinct(df, ["pid"], "ex", 3, salts=4).first()["values"] == ["1", "2", "3"]
