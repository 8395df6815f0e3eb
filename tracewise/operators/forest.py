"""A random forest whose trees are grown, kept and applied by the executors.

The same learner as Spark's ``RandomForestClassifier`` at its defaults: up to 32 bins a feature, their borders found in
a sample of about 10,000 rows; rows drawn by Poisson(1); the square root of the features tried at a node; the split of
the largest Gini gain; two leaves of the same class merged.  Spark's own sends the statistics of every open node once a
level and partition, and keeps all nodes of all trees on the driver.  Here

* rows equal in bins and class become one with a count, and go packed in blocks to each group of trees;
* a task grows its trees one after the other from a file of its own (24 bytes a row), with counts of about
  ``CELLS`` cells and ``ROWS`` rows at a time in memory, and some 13 bytes for each row that a tree draws;
* trees are written to the shared folder, and the driver sees their importances only;
* a prediction sends the distinct rows to each group of trees and sums the votes in whole numbers.

A tree depends on the rows, the borders and the seed, not on how the rows are dealt out."""

from __future__ import annotations

import itertools
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.session import checkpoint_dir

BLOCK = 16_384  # rows of a block
ROWS = 1 << 18  # rows that are counted at a time
CELLS = 1 << 20  # counts (node x bin x class) that are held at a time
SAMPLE = 10_000  # rows, about, that the borders of the bins are found in
VOTE = 1 << 40  # a tree's vote in whole numbers: sums do not depend on their order
LEAST_GAIN = 1e-12  # less is rounding
BATCH_BYTES = 8 << 20  # of rows that Spark hands to Python at once


# --- one tree -------------------------------------------------------------------------

def borders(values: np.ndarray, bins: int) -> np.ndarray:
    """The borders of at most ``bins`` bins, as Spark's trees place them: between all values where they are few, else
    where the count of rows comes closest to a multiple of a stride."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    stride = n.sum() / bins
    out, target, upto = [], stride, int(n[0])
    for k in range(1, len(v)):
        before, upto = upto, upto + int(n[k])
        if abs(before - target) < abs(upto - target):
            out.append((v[k - 1] + v[k]) / 2)
            target += stride
    return np.array(out[: bins - 1])


def _slices(start: int, stop: int):
    return (slice(a, min(a + ROWS, stop)) for a in range(start, stop, ROWS))


def grow(x: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int, bins: int, depth: int, rng: np.random.Generator) -> dict:
    """One tree over rows ``x`` (bins by feature) of class ``y``, each there ``n`` times, level by level.

    Returns arrays by node: feature (-1 in a leaf), bin (up to which rows go left), left (the right child follows it),
    counts (by class) and gain."""
    features = x.shape[1]
    tried = min(features, math.ceil(math.sqrt(features)))
    flat = x.reshape(-1)
    index, drawn = np.int32 if len(y) < 2**31 else np.int64, []
    for s in _slices(0, len(y)):
        d = rng.poisson(n[s]).astype(np.int32)
        drawn.append(((np.flatnonzero(d) + s.start).astype(index), d[d > 0]))
    rows, w = (np.concatenate([d[i] for d in drawn]) for i in (0, 1))
    del drawn
    node = np.zeros(len(rows), np.int32)  # among the open ones of the level
    counts = sum((np.bincount(y[rows[s]], w[s], classes) for s in _slices(0, len(rows))), np.zeros(classes))[None]
    tree, first, level = {k: [] for k in ("feature", "bin", "left", "counts", "gain")}, 0, 0
    can_split = ((counts > 0).sum(1) > 1) if depth > 0 else np.zeros(1, bool)
    while len(counts):
        k_all, at = len(counts), np.flatnonzero(can_split)
        k_open = len(at)
        of_open = {"feature": np.full(k_open, -1, np.int32), "bin": np.zeros(k_open, np.int32), "gain": np.zeros(k_open), "lefts": np.zeros((k_open, classes))}
        asked = np.empty((k_open, tried), np.int64)
        for a in range(0, k_open, BLOCK):
            asked[a : a + BLOCK] = rng.random((min(BLOCK, k_open - a), features)).argpartition(tried - 1, 1)[:, :tried]
        step = max(1, CELLS // (bins * classes))
        if k_open > step:  # nodes that are counted together lie together
            order = np.argsort((node // step).astype(np.uint16 if k_open // step < 2**16 else np.int32), kind="stable")
            rows, w, node = rows[order], w[order], node[order]
            del order
            ends = np.searchsorted(node // step, np.arange(-(-k_open // step)), "right")
        else:
            ends = [len(rows)]
        start = 0
        for chunk, stop in zip(range(0, k_open, step), ends):
            _best_splits(flat, y, rows, w, node, asked, slice(chunk, min(chunk + step, k_open)), slice(start, int(stop)), counts[at], bins, classes, features, of_open)
            start = int(stop)
        split = of_open["feature"] >= 0
        into = np.cumsum(split) - 1  # of the children's pairs
        pairs = int(split.sum())
        whole = lambda v, fill: _spread(v, at, k_all, fill)
        tree["feature"].append(whole(of_open["feature"], -1))
        tree["bin"].append(whole(of_open["bin"], 0))
        tree["gain"].append(whole(of_open["gain"], 0.0))
        tree["left"].append(whole(np.where(split, first + k_all + 2 * into, -1), -1))
        tree["counts"].append(counts)
        lefts = of_open["lefts"][split]
        below = np.stack([lefts, counts[at][split] - lefts], 1).reshape(2 * pairs, classes)
        level += 1
        can_split = ((below > 0).sum(1) > 1) if level < depth else np.zeros(2 * pairs, bool)
        opened = (np.cumsum(can_split) - 1).astype(np.int32)
        kept = []
        for s in _slices(0, len(rows)):
            k = node[s]
            on = split[k]
            r, k, v = rows[s][on], k[on], w[s][on]
            child = 2 * into[k] + (flat[r.astype(np.int64) * features + of_open["feature"][k]] > of_open["bin"][k])
            on = can_split[child]
            kept.append((r[on], v[on], opened[child[on]]))
        rows, w, node = (np.concatenate([k[i] for k in kept]) if kept else np.empty(0, d) for i, d in enumerate((rows.dtype, np.int32, np.int32)))
        first, counts = first + k_all, below
    return _merged({k: np.concatenate(v) for k, v in tree.items()}, np.cumsum([0, *map(len, tree["left"])]))


def _spread(values, at, n, fill):
    out = np.full(n, fill, np.asarray(values).dtype)
    out[at] = values
    return out


def _best_splits(flat, y, rows, w, node, asked, nodes, part, counts, bins, classes, features, out) -> None:
    """The best split of each of ``nodes``, whose rows are those of ``part``, over the features asked of it."""
    k = nodes.stop - nodes.start
    total = counts[nodes]
    size = total.sum(1)
    square = (total * total).sum(1) / (size * size)
    each = np.arange(k)
    for j in range(asked.shape[1]):
        cells = np.zeros(k * bins * classes)
        for s in _slices(part.start, part.stop):
            r, c = rows[s].astype(np.int64), node[s]
            v = flat[r * features + asked[c, j]]
            cells += np.bincount(((c - nodes.start).astype(np.int64) * bins + v) * classes + y[r], w[s], len(cells))
        left = cells.reshape(k, bins, classes).cumsum(1)
        right = total[:, None, :] - left
        n_left = left.sum(2)
        n_right = size[:, None] - n_left
        ok = (n_left > 0) & (n_right > 0)
        score = np.einsum("kbc,kbc->kb", left, left) / np.where(ok, n_left, 1) + np.einsum("kbc,kbc->kb", right, right) / np.where(ok, n_right, 1)
        score[~ok] = -1.0
        b = score.argmax(1)
        gain = score[each, b] / size - square
        better = np.flatnonzero(gain > np.maximum(out["gain"][nodes], LEAST_GAIN))
        at = better + nodes.start
        out["gain"][at], out["bin"][at], out["feature"][at] = gain[better], b[better], asked[at, j]
        out["lefts"][at] = left[better, b[better]]


def _merged(t: dict, levels: np.ndarray) -> dict:
    """Without the leaves that say the same as the leaf beside them, from the deepest level up."""
    says = t["counts"].argmax(1)
    for a, b in zip(levels[-2::-1], levels[:0:-1]):
        k = np.arange(a, b)
        k = k[t["feature"][k] >= 0]
        one, two = t["left"][k], t["left"][k] + 1
        same = k[(t["feature"][one] < 0) & (t["feature"][two] < 0) & (says[one] == says[two])]
        t["feature"][same] = -1
    used = np.zeros(len(says), bool)
    used[0] = True
    for a, b in zip(levels[:-1], levels[1:]):
        k = np.arange(a, b)
        k = k[used[k] & (t["feature"][k] >= 0)]
        used[t["left"][k]] = used[t["left"][k] + 1] = True
    now = np.cumsum(used) - 1
    t = {k: v[used] for k, v in t.items()}
    t["left"] = np.where(t["feature"] >= 0, now[t["left"]], -1)
    return t


def importances(t: dict, features: int) -> np.ndarray:
    """Of one tree: gain by rows of each feature's splits, 1 in all."""
    k = t["feature"] >= 0
    out = np.bincount(t["feature"][k], t["gain"][k] * t["counts"][k].sum(1), features)
    return out / out.sum() if out.sum() > 0 else out


def packed(t: dict) -> bytes:
    """Number of nodes; feature, bin and left of each; the counts of the leaves, which ``left`` numbers from -1 down."""
    leaf = t["feature"] < 0
    left = np.where(leaf, -np.cumsum(leaf), t["left"])
    return b"".join([np.int64(len(leaf)).tobytes(), t["feature"].astype("<i4").tobytes(), t["bin"].astype("<i4").tobytes(), left.astype("<i8").tobytes(),
                     t["counts"][leaf].astype("<i8").tobytes()])


def votes(blob: bytes, x: np.ndarray, classes: int) -> np.ndarray:
    """What a packed tree votes for each row of ``x``: by class the share of its leaf, in whole numbers."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    feature, border = np.frombuffer(blob, "<i4", n, 8), np.frombuffer(blob, "<i4", n, 8 + 4 * n)
    left, counts = np.frombuffer(blob, "<i8", n, 8 + 8 * n), np.frombuffer(blob, "<i8", -1, 8 + 16 * n).reshape(-1, classes)
    flat, at = x.reshape(-1), np.zeros(len(x), np.int64)
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        k = at[rows]
        k = left[k] + (flat[rows * x.shape[1] + feature[k]] > border[k])
        at[rows] = k
        rows = rows[feature[k] >= 0]
    share = np.rint(counts / np.maximum(counts.sum(1, keepdims=True), 1) * VOTE).astype(np.int64)
    return share[-1 - left[at]]


# --- over tables ----------------------------------------------------------------------

def _binned(features, cuts: list[list[float]]):
    """Column of the bins of a vector column: a byte a feature."""
    cuts = [np.array(c) for c in cuts]

    def bins(v):
        v = np.stack(v.to_numpy()) if len(v) else np.empty((0, len(cuts)))
        out = np.column_stack([np.searchsorted(c, v[:, k]) for k, c in enumerate(cuts)]).astype(np.uint8)
        return _series([r.tobytes() for r in out])

    return F.pandas_udf(bins, "binary")(vector_to_array(features))


def _series(values):
    import pandas as pd

    return pd.Series(values, dtype=object)


def _blocks(df: DataFrame) -> DataFrame:
    """(at, x, y, n): the rows (bins, y, n) of each partition in their order, packed; ``at`` is the block's first row."""

    def pack(batches):
        held, size = [], 0

        def block(t):
            x, y = t["bins"].combine_chunks(), t["y"].to_numpy().astype("<i4").tobytes()
            return pa.RecordBatch.from_pylist([{"at": x[0].as_py() + int(t["y"][0].as_py()).to_bytes(4, "big"), "x": b"".join(x.to_pylist()), "y": y, "n": t["n"].to_numpy().astype("<i8").tobytes()}],
                                              schema=pa.schema([("at", pa.binary()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.binary())]))

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            while size >= BLOCK:
                t = pa.concat_tables(held)
                yield block(t.slice(0, BLOCK))
                held, size = [t.slice(BLOCK)], size - BLOCK
        if size:
            yield block(pa.concat_tables(held))

    return df.select("bins", F.col("y").cast("int").alias("y"), F.col("n").cast("long").alias("n")).mapInArrow(pack, "at binary, x binary, y binary, n binary")


def _small_batches(spark) -> None:
    """Hand at most BATCH_BYTES at a time to Python, so that a group's blocks stream through it (only ever lowers the setting)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, f"{BATCH_BYTES + 1}b"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def _groups(spark, trees: int) -> list[int]:
    """A key for each group of trees: keys that a repartition by ``g`` into as many partitions deals to one each."""
    n = min(trees, 2 * max(1, spark.sparkContext.defaultParallelism))
    keys = spark.range(64 * n).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    return sorted(r.id for r in keys.collect())


def _to_groups(df: DataFrame, keys: list[int], *order: str) -> DataFrame:
    g = F.explode(F.array(*[F.lit(k).cast("int") for k in keys])).alias("g")
    return df.select(g, "*").repartition(len(keys), "g").sortWithinPartitions("g", *order)


def _records(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}


class _Forest(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels of splits", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature, up to 256", typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=20, maxDepth=5, maxBins=32, seed=42)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


class Forest(Estimator, _Forest, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of a ``ForestModel``; labels are whole numbers from 0 up."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numTrees=20, maxDepth=5, maxBins=32, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ForestModel:
        spark, seed, bins, depth = df.sparkSession, self.getSeed(), self.getOrDefault(self.maxBins), self.getMaxDepth()
        if not 2 <= bins <= 256:
            raise ValueError("maxBins must be from 2 to 256")
        _small_batches(spark)
        df = df.select(F.col(self.getFeaturesCol()).alias("v"), F.col(self.getLabelCol()).cast("long").alias("y"))
        rows, top = df.agg(F.count(F.lit(1)), F.max("y")).first()
        if not rows:
            raise ValueError("no rows to grow trees from")
        classes = max(top + 1, 2)
        asked = max(bins * bins, SAMPLE) / rows
        found = (df if asked >= 1 else df.sample(False, asked, seed)).select("v").collect()
        cuts = [borders(c, bins).tolist() for c in np.array([r.v.toArray() for r in found]).T]
        width, trees, keys = len(cuts), self.getNumTrees(), _groups(spark, self.getNumTrees())
        counted = df.select(_binned("v", cuts).alias("bins"), "y").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))
        blocks = _blocks(counted.repartitionByRange("bins", "y").sortWithinPartitions("bins", "y"))
        small = np.uint8 if classes <= 256 else np.uint16 if classes <= 65_536 else np.int32

        def train(batches):
            for g, mine in itertools.groupby(_records(batches), lambda r: r["g"]):
                with tempfile.TemporaryFile() as f:
                    y, n = [], []
                    for r in mine:
                        f.write(r["x"])
                        y.append(np.frombuffer(r["y"], "<i4").astype(small))
                        n.append(np.frombuffer(r["n"], "<i8").astype(np.int32))
                    f.flush()
                    y, n = np.concatenate(y), np.concatenate(n)
                    x = np.memmap(f, np.uint8, "r", shape=(len(y), width))
                    for k in range(keys.index(g), trees, len(keys)):
                        t = grow(x, y, n, classes, bins, depth, np.random.Generator(np.random.PCG64([seed, k])))
                        yield pa.RecordBatch.from_pylist([{"tree": k, "nodes": len(t["left"]), "importances": importances(t, width).tolist(), "body": packed(t)}],
                                                         schema=pa.schema([("tree", pa.int32()), ("nodes", pa.int64()), ("importances", pa.list_(pa.float64())), ("body", pa.binary())]))
                    del x

        path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
        grown = _to_groups(blocks, keys, "at").mapInArrow(train, "tree int, nodes long, importances array<double>, body binary")
        grown.write.parquet(path)
        about = spark.read.parquet(path).select("tree", "nodes", "importances").orderBy("tree").collect()
        total = np.sum([r.importances for r in about], axis=0)
        model = ForestModel(path, cuts, classes, sum(r.nodes for r in about), (total / total.sum() if total.sum() > 0 else total).tolist())
        return self._copyValues(model)


class ForestModel(Model, _Forest, MLReadable, MLWritable):
    """Trees in a table of the shared folder; here are their number, the borders of the bins and the importances."""

    def __init__(self, path: str = "", cuts=(), classes: int = 0, nodes: int = 0, weights=()):
        super().__init__()
        self.path, self.cuts, self.numClasses, self.totalNumNodes, self.weights = path, cuts, classes, nodes, weights

    @property
    def featureImportances(self):
        return Vectors.dense(self.weights)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, width, classes = df.sparkSession, len(self.cuts), self.numClasses
        keys = _groups(spark, self.getNumTrees())
        _small_batches(spark)
        df = df.withColumn("_bins", _binned(self.getFeaturesCol(), self.cuts))
        rows = _blocks(df.groupBy(F.col("_bins").alias("bins")).agg(F.lit(0).alias("y"), F.lit(1).alias("n")))
        key = F.element_at(F.array(*[F.lit(k).cast("int") for k in keys]), F.pmod("tree", F.lit(len(keys))) + 1)
        none = F.lit(None).cast("binary")
        trees = spark.read.parquet(self.path).select(key.alias("g"), "body", F.lit(0).alias("kind"), none.alias("x"))
        to_all = F.explode(F.array(*[F.lit(k).cast("int") for k in keys]))
        both = trees.unionByName(rows.select(to_all.alias("g"), none.alias("body"), F.lit(1).alias("kind"), "x"))

        def vote(batches):
            for _, mine in itertools.groupby(_records(batches), lambda r: r["g"]):
                held = []
                for r in mine:
                    if r["kind"] == 0:
                        held.append(r["body"])
                        continue
                    x = np.frombuffer(r["x"], np.uint8).reshape(-1, width)
                    said = sum((votes(t, x, classes) for t in held), np.zeros((len(x), classes), np.int64))
                    yield pa.RecordBatch.from_pylist([{"x": r["x"], "votes": said.tobytes()}], schema=pa.schema([("x", pa.binary()), ("votes", pa.binary())]))

        def total(batches):
            # a block's first row is in no other
            for x, mine in itertools.groupby(_records(batches), lambda r: r["x"]):
                said = sum(np.frombuffer(r["votes"], np.int64) for r in mine).reshape(-1, classes) / VOTE
                yield pa.RecordBatch.from_arrays([pa.array([x[a : a + width] for a in range(0, len(x), width)], pa.binary()), pa.array(said.tolist(), pa.list_(pa.float64()))], ["_bins", "_votes"])

        said = both.repartition(len(keys), "g").sortWithinPartitions("g", "kind").mapInArrow(vote, "x binary, votes binary")
        said = said.repartition("x").sortWithinPartitions("x").mapInArrow(total, "_bins binary, _votes array<double>")
        share = F.transform("_votes", lambda v: v / F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b))
        out = df.join(said, "_bins").withColumns({
            self.getRawPredictionCol(): array_to_vector("_votes"), self.getProbabilityCol(): array_to_vector(share),
            self.getPredictionCol(): (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")})
        return out.drop("_bins", "_votes")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        more = {"cuts": [list(c) for c in m.cuts], "classes": m.numClasses, "nodes": m.totalNumNodes, "weights": list(m.weights)}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=more)
        self.sparkSession.read.parquet(m.path).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(f"{path}/trees", meta["cuts"], meta["classes"], meta["nodes"], meta["weights"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
