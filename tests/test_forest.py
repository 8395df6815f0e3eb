"""The random forest: trees by plain counting, the same in any layout and with any memory, kept by the executors."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewise.operators import classify, forest
from tracewise.operators.fingerprint import FEATURE_NAMES


def grown(x, y, n, depth=20, seed=3, classes=3):
    return forest.grow(x, y, n, classes, 8, depth, np.random.default_rng(seed))


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (700, 5)).astype(np.uint8)
    return x, ((x[:, 0] > 3) + (rng.random(700) < 0.3)).astype(np.uint8), rng.integers(1, 4, 700).astype(np.int32)


def test_a_tree_is_the_same_however_little_is_counted_at_a_time(monkeypatch, rows):
    want = forest.packed(grown(*rows))
    monkeypatch.setattr(forest, "ROWS", 13)
    monkeypatch.setattr(forest, "CELLS", 60)
    assert forest.packed(grown(*rows)) == want


def test_first_split_has_the_largest_gain():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, (200, 1)).astype(np.uint8), rng.integers(0, 3, 200).astype(np.uint8)
    t = grown(x, y, np.ones(200, np.int32), depth=1)
    w = np.random.default_rng(3).poisson(np.ones(200))
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    count = lambda on: np.bincount(y[on], w[on], 3)
    every = np.ones(200, bool)
    gains = []
    for b in range(7):
        a, c = count(x[:, 0] <= b), count(x[:, 0] > b)
        gains.append(gini(count(every)) - (a.sum() * gini(a) + c.sum() * gini(c)) / w.sum())
    assert t["counts"][0].tolist() == count(every).tolist()
    if t["feature"][0] == 0:  # not merged
        assert t["bin"][0] == int(np.argmax(gains)) and t["gain"][0] == pytest.approx(max(gains))
        assert t["counts"][1].tolist() == count(x[:, 0] <= t["bin"][0]).tolist()


def test_votes_follow_the_splits(rows):
    x, y, n = rows
    t = grown(x, y, n)
    got = forest.votes(forest.packed(t), x, 3)
    for r, v in zip(x, got):
        k = 0
        while t["feature"][k] >= 0:
            k = t["left"][k] + int(r[t["feature"][k]] > t["bin"][k])
        assert v.tolist() == np.rint(t["counts"][k] / t["counts"][k].sum() * forest.VOTE).tolist()
    leaf = t["feature"] < 0
    pairs = [(k, k + 1) for k in t["left"][~leaf]]
    assert not any(leaf[a] and leaf[b] and t["counts"][a].argmax() == t["counts"][b].argmax() for a, b in pairs)


def test_borders_few_and_many():
    assert forest.borders(np.array([3.0, 1, 1, 2]), 32).tolist() == [1.5, 2.5]
    cuts = forest.borders(np.arange(1000.0), 4)
    assert len(cuts) == 3 and np.allclose(cuts, [250, 500, 750], atol=2)


def _table(spark, n=900):
    x = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)).cast("double") for k in range(4)]
    t = spark.range(n).select("id", F.array(*x).alias("f"))
    return t.select("id", array_to_vector("f").alias("features"), (F.col("f")[0] * 2 > F.col("f")[1] + 30).cast("double").alias("label"))


def test_forest_in_any_layout_saved_and_loaded(spark, tmp_path):
    df = _table(spark)
    got = []
    for parts in (1, 7):
        model = forest.Forest(numTrees=9, maxDepth=8, seed=4).fit(df.union(df).repartition(parts))
        said = model.transform(df.repartition(parts + 1))
        got.append((model.featureImportances.toArray().tolist(), model.totalNumNodes, sorted((r.id, r.prediction, r.probability.toArray().tolist()) for r in said.collect())))
    assert got[0] == got[1] and len(got[0][2]) == 900
    assert said.filter("prediction = label").count() > 0.9 * 900 and np.argmax(got[0][0]) == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = forest.ForestModel.load(str(tmp_path / "m"))
    assert sorted((r.id, r.prediction, r.probability.toArray().tolist()) for r in again.transform(df).collect()) == got[1][2]
    assert again.getNumTrees() == 9 and again.totalNumNodes == model.totalNumNodes


def test_blocks_come_to_a_task_a_few_at_a_time(spark):
    df = _table(spark)
    forest.Forest(numTrees=2, maxDepth=2).fit(df)
    block = F.repeat(F.lit("x"), 540_000).cast("binary")

    def size(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int32())]))

    seen = [r.n for r in spark.range(0, 60, 1, 1).select(block.alias("x")).mapInArrow(size, "n int").collect()]
    assert sum(seen) == 60 and max(seen) * 540_000 <= forest.BATCH_BYTES + 540_000


def _fingerprints(spark):
    x = {c: F.pmod(F.xxhash64("chain_id", F.lit(c)), F.lit(9)).cast("double") for c in FEATURE_NAMES}
    return spark.range(400).withColumnRenamed("id", "chain_id").select("chain_id", *[v.alias(c) for c, v in x.items()]).withColumn(
        "lang", F.when(F.col("num_steps") > 4, "en").otherwise("fr"))


def test_no_tree_comes_to_the_driver(spark, monkeypatch):
    train, test = classify.train_test(_fingerprints(spark), "lang")
    model = classify.fit(train, cv_folds=2, num_trees=6, max_depth=5)
    assert 0 <= model.avgMetrics[0] <= 1
    trees = model.bestModel.stages[-1]
    assert trees.getNumTrees() == 6 and trees.getMaxDepth() == 5
    held = [v for v in vars(trees).values() if isinstance(v, bytes | bytearray | np.ndarray)]
    assert not held and spark.read.parquet(trees.path).count() == 6
    assert classify.predict(model, test).count() == test.count()
    assert classify.feature_importance(model, 1).first().feature == "num_steps"


def test_a_verdict_predicts_each_row_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def guess(p):
        calls.add(1)
        return [p, 1 - p]

    pred = spark.createDataFrame([(1, 0.2), (2, 0.7)], "chain_id long, p double").select(
        "chain_id", array_to_vector(F.udf(guess, "array<double>")("p")).alias("probability"))
    shown = spark.createDataFrame([("a", "A"), ("b", "B")], "label_name string, display string")
    out = classify.verdict(pred, ["a", "b"], shown).collect()
    assert {r.chain_id: r.verdict for r in out} == {1: "B", 2: "A"}
    assert calls.value == 2
