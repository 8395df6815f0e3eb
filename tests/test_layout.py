"""Table layout, pages and lookups; medians by narrowing; semantic edges by tiles."""

import os
import random
import re
import statistics
import tempfile

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tracewise.operators import evaluate, graph, risk, validate
from tracewise.plans import QUERIES
from tracewise.plans.catalog_validate import validation_input
from tracewise.sources import io
from tracewise.sources.fixtures import order_chains, order_edges, order_steps


def scratch(name):
    return tempfile.mkdtemp(prefix=f"tw-{name}-", dir="/tmp")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bucketed(spark):
    keys = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    d, names = scratch("bucket"), []

    def write(df, name):
        names.append(name)
        return io.write_bucketed(df, name, f"{d}/{name}", 6)

    for k, v in keys.items():
        spark.conf.set(k, v)
    yield write
    for n in names:
        spark.sql(f"drop table if exists {n}")
    for k, v in before.items():
        spark.conf.set(k, v)


def test_bucketed_tables_are_not_shuffled_again(spark, bucketed):
    steps = order_steps(spark, SF001)
    edges = order_edges(steps)
    s, e = bucketed(steps, "t_steps"), bucketed(edges, "t_edges")
    nodes = lambda x: x.select("chain_id", F.col("idx").alias("node"))
    for mine, plain in ((risk.lookahead_labels(s), risk.lookahead_labels(steps)), (graph._degrees_by_joins(nodes(s), e), graph._degrees_by_joins(nodes(steps), edges))):
        assert exchanges(mine) == [] and exchanges(plain)
        assert rows(mine) == rows(plain)


def test_validation_of_bucketed_tables(spark, bucketed):
    plain = validation_input(spark, SF001)
    mine = [bucketed(df, f"t_val{k}") for k, df in enumerate(plain)]
    got = validate.validation_messages(*mine)
    # only the few chains whose nodes mismatch meet once more
    assert len(exchanges(got)) <= 1 < len(exchanges(validate.validation_messages(*plain)))
    assert rows(got) == rows(validate.validation_messages(*plain))


def test_a_lookup_reads_one_row_group(spark):
    d = scratch("lookup")
    table = spark.range(200_000).select(F.col("id").alias("chain_id"), F.md5(F.col("id").cast("string")).alias("query"))
    io.write_lookup(table, d, group_bytes=1 << 16)
    groups, most = 0, 0
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(f"{d}/{f}").metadata
            groups += meta.num_row_groups
            for g in range(meta.num_row_groups):
                most = max(most, meta.row_group(g).num_rows)
    assert groups > 10
    got = validate.lookup_chain(spark.read.parquet(d), 123_457)
    found = got.collect()
    assert [r.query for r in found] == [table.filter("chain_id = 123457").first().query]
    assert "PushedFilters: [IsNotNull(chain_id), EqualTo(chain_id,123457)]" in plan(got)
    node = got._jdf.queryExecution().executedPlan()
    read = [int(m) for m in re.findall(r"numOutputRows -> (\d+)", str(node))]
    leaf = node.collectLeaves().apply(0)
    assert read == [] and leaf.metrics().get("numOutputRows").get().value() <= most < 200_000 / 10


def test_pages_follow_each_other(spark):
    steps, chains = order_steps(spark, SF001), order_chains(spark, SF001).withColumn("query", F.col("chain_id").cast("string"))
    whole = [r.chain_id for r in validate.chain_listing(steps, chains).orderBy("chain_id").collect()]
    seen, after = [], None
    for _ in range(4):
        page = validate.chain_listing(steps, chains, limit=37, after=after).orderBy("chain_id").collect()
        seen += [r.chain_id for r in page]
        after = seen[-1]
    assert seen == whole[: 4 * 37]
    everything = {r.chain_id: tuple(r) for r in validate.chain_listing(steps, chains).collect()}
    assert all(tuple(r) == everything[r.chain_id] for r in page)


def test_several_files_a_model(spark):
    out = QUERIES["chain_files"](spark, SF001).collect()
    assert len(out) == 4 and all(r.total == r.valid + r.invalid for r in out)
    d = scratch("files")
    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("model"), F.col("id").cast("string").alias("query_id"))
    io.write_chains_jsonl(df.repartition(5), f"{d}/x", partition_by=["model"])
    io.name_files(spark, f"{d}/x", "model", "m{}_math_chains-{{:05d}}.jsonl".replace("{{", "{").replace("}}", "}"))
    names = sorted(f for f in os.listdir(f"{d}/x") if f.endswith(".jsonl"))
    assert names == [f"m{m}_math_chains-{k:05d}.jsonl" for m in "01" for k in range(5)]
    keyed = io.key_from_file_name(spark.createDataFrame([(n,) for n in [*names, "gpt4_code_chains.jsonl.gz"]], "file_name string"))
    assert {(r.model_type, r.file_domain) for r in keyed.collect()} == {("m0", "math"), ("m1", "math"), ("gpt4", "code")}


@pytest.mark.parametrize("bins", [2, 1024])
def test_medians(spark, monkeypatch, bins):
    monkeypatch.setattr(validate, "BINS", bins)
    random.seed(5)
    data = [(k, random.choice([None, random.random(), random.randint(-5, 5) * 1.0, 1e300 * random.random(), -1e300, 5e-324]), float(n))
            for k in ("a", "b", None) for n in range(151 if k else 60)] + [("c", None, 2.0)]
    got = {r.k: r for r in validate.exact_medians(spark.createDataFrame(data, "k string, x double, y double"), "k", ["x", "y"]).collect()}
    for k in ("a", "b", None, "c"):
        for c, at in (("x_median", 1), ("y_median", 2)):
            values = [r[at] for r in data if r[0] == k and r[at] is not None]
            assert got[k][c] == (pytest.approx(statistics.median(values)) if values else None)


def test_semantic_edges_of_a_long_chain(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 48))
    long = [("long", i, (centres[i % 40] + 0.2 * rng.normal(size=48)).tolist()) for i in range(5000)]
    short = [("short", i, rng.normal(size=3).tolist()) for i in range(9)] + [("short", 9, [0.0] * 3)]
    df = spark.createDataFrame(long + short, "chain_id string, idx long, embedding array<double>").repartition(7)
    tiles = graph.semantic_tiles(df, 0.7).cache()
    want = set()
    for c, part in (("long", long), ("short", short)):
        v = np.array([r[2] for r in part])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        want |= {(c, int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.7, 1)))}
    got = tiles.select("chain_id", F.inline("edges")).select("chain_id", "src", "dst").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    total = tiles.groupBy("chain_id").agg(F.sum("possible").alias("p"), F.sum("tested").alias("t")).collect()
    by = {r.chain_id: r for r in total}
    assert by["long"].p == 5000 * 4999 // 2 and by["short"].p == 45 and by["long"].t < 0.5 * by["long"].p


def test_scores_outside_the_unit_range(spark):
    random.seed(2)
    data = [(random.choice("ab"), random.randint(0, 1), random.choice([-3.0, 0.5, 7.0, random.gauss(0, 9)])) for _ in range(700)]
    got = {r.k: r.auroc for r in evaluate.auroc(spark.createDataFrame(data, "k string, y int, score double"), ["k"]).collect()}
    for k in "ab":
        pos, neg = ([s for g, y, s in data if g == k and y == v] for v in (1, 0))
        u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[k] == pytest.approx(u / len(pos) / len(neg), abs=1e-6)
