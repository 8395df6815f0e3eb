"""IO round trips (IO1–IO14) and rule lookups (L1–L4)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tracewise.operators import lookup
from tracewise.sources import io

CHAIN = {"domain": "math", "query_id": "q1", "query": "2+2", "ground_truth": "4",
         "reasoning_steps": [{"step_id": 0, "text": "a", "is_correct": True, "depends_on": []},
                             {"step_id": 1, "text": "b", "is_correct": False, "is_origin": True,
                              "error_type": "logical", "depends_on": [0]}],
         "dependency_graph": {"nodes": [0, 1], "edges": [[0, 1]]}}


def _write(dirpath, name, lines):
    with open(os.path.join(dirpath, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_chains_tolerates_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="tw-io-", dir="/tmp")
    bad_domain = dict(CHAIN, query_id="q2", domain="physics")
    _write(d, "gpt4_math_chains.jsonl", [json.dumps(CHAIN), "{not json", json.dumps(bad_domain)])
    df = io.read_chains(spark, d)
    errs = {r.query_id: r.parse_error for r in df.collect()}
    assert errs["q1"] is None and errs["q2"].startswith("Parse error: bad domain")
    assert sum(1 for v in errs.values() if v and "malformed" in v) == 1
    keyed = io.key_from_file_name(df).filter("query_id = 'q1'").first()
    assert (keyed.model_type, keyed.file_domain) == ("gpt4", "math")
    st = io.file_stats(df).first()
    assert (st.total, st.valid, st.invalid) == (3, 1, 2)
    # codec defaults: missing is_origin -> False
    assert df.filter("query_id = 'q1'").first().reasoning_steps[0].is_origin is False


def test_capped_and_dataset(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in io.read_capped(df, 3, ["k"]).collect()] == [0, 1, 2]
    d = tempfile.mkdtemp(prefix="tw-ds-", dir="/tmp")
    df.withColumn("split", F.when(F.col("k") < 7, "train").otherwise("test")).write.partitionBy("split").mode("overwrite").parquet(d)
    assert io.read_dataset(spark, d).count() == 7
    try:
        io.read_dataset(spark, d, "val")
        raise AssertionError("missing split must fail")
    except ValueError:
        pass


def test_preference_pairs_and_models(spark):
    conv = "array<struct<role:string,content:string>>"
    pairs = spark.createDataFrame([
        (1, "gpt-4-0613", [("user", "hi")], "llama-2-70b-chat", [("user", "hi")]),
        (2, "claude-v1", [("user", "x")], "vicuna", [("user", "x")]),
        (3, "gpt-4", [("user", "y")], "gpt-4", [("user", "y")]),
    ], f"pair_id long, chosen_model string, chosen {conv}, rejected_model string, rejected {conv}")
    mapping = [("gpt-4", "gpt4"), ("llama", "llama"), ("claude", "claude")]
    assert io.preference_pairs(pairs, mapping).filter("model_type = 'gpt4'").count() == 3
    out = io.preference_pairs(pairs, mapping, cap=2)
    counts = {r.model_type: r["count"] for r in out.groupBy("model_type").count().collect()}
    assert counts == {"gpt4": 2, "llama": 1, "claude": 1}
    models = [r.model for r in io.distinct_models(pairs, "chosen_model", "rejected_model").collect()]
    assert models == sorted(set(models)) and "vicuna" in models


def test_lookups(spark):
    s = spark.createDataFrame([("c", 0, "This is verified"), ("c", 1, "possible Error here"), ("d", 0, "a greeting")],
                              "chain_id string, idx long, text string")
    st = {(r.chain_id, r.idx): r.status for r in lookup.step_status(s).collect()}
    assert st == {("c", 0): "safe", ("c", 1): "risk", ("d", 0): "neutral"}
    al = {r.chain_id: r.allowed for r in lookup.allow_rule(s).collect()}
    assert al == {"c": False, "d": True}
    p = spark.createDataFrame([(0.9,), (0.55,)], "p double")
    ex = lookup.safety_explanation(p, "p").orderBy("p").collect()
    assert [(r.status, r.confidence) for r in ex] == [("UNSAFE", "10.00%"), ("SAFE", "80.00%")]
    q = spark.createDataFrame([("a", "what is sqrt(-16)?"), ("b", "delete /tmp"), ("c", "hello")], "k string, query string")
    ctx = {r.k: r.context for r in lookup.context_lookup(q, lookup.CONTEXT_RULES).collect()}
    assert "4i" in ctx["a"] and "deletion" in ctx["b"] and ctx["c"] == ""
