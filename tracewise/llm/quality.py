"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (counts, scaled to length 1 over the text), STATS measures of
its form between 0 and 1, and two numbers per metadata column (its size, and whether it is missing).  The score is
the logistic of  w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2],  so the low-rank
interactions of all pairs cost one pass over a text's features.

``fit`` learns on at most ``max_rows`` labelled rows (those whose hashed id is smallest), a documented bound:
their features come to the driver, where mini-batch AdaGrad runs in numpy.  A row has at most
WORDS + STATS + 2 a metadata column features, so ``max_rows`` bounds the driver's memory (worst 530 MB at 8000
rows; a text of 300 words makes it 20 MB).  Scoring sends the model (WORDS x RANK floats) to the tasks and reads whole texts.

Null or empty text: no words, statistics of an empty text; scored like any other.  Null metadata has its own
feature.  Null labels don't train; several labels of one id are averaged.  Without both classes among the
labels every score is the smoothed share of label 1.  Repeated rows are scored each for itself.  Long texts
are scored whole, block by block.  An empty table gives an empty result.  A column of the name that is added is replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewise.llm.common import U64, small_batches, spans, utf8, word_hashes, word_spans

WORDS = 1 << 13
STATS = 13
RANK = 8
MAX_ROWS = 8000
EPOCHS = 8
BATCH = 128
RATE, L2 = 0.08, 1e-4

_CLASSES = {"symbol": b"#*$%&|<>{}[]=+_~^\\/@", "digit": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            "lower": b"abcdefghijklmnopqrstuvwxyz", "stop": b".?,;:", "bang": b"!", "bar": b"|", "line": b"\n"}
_IS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)).astype(np.int32) for k, v in _CLASSES.items()}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, a / np.maximum(b, 1))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def features(texts: pa.Array, metadata: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, feature numbers, values) of a text column."""
    data, off = utf8(texts)
    n, extra = len(off) - 1, STATS + 2 * len(metadata)
    sizes, numbers, values = np.zeros(n, np.int64), [], []
    meta = np.zeros((n, 2 * len(metadata)))
    for k, m in enumerate(metadata):
        missing = np.asarray(m.is_null())
        x = np.nan_to_num(m.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
        meta[:, 2 * k], meta[:, 2 * k + 1] = np.minimum(1.0, np.log1p(np.maximum(x, 0)) / 15), missing
    for i, j in spans(off):
        raw, at = data[off[i]: off[j]], off[i: j + 1] - off[i]
        rows = j - i
        starts, ends = word_spans(raw, at)
        hashes = word_hashes(raw, starts, ends)
        row = np.searchsorted(at, starts, "right") - 1
        words = np.bincount(row, minlength=rows)
        key, count = np.unique(row * WORDS + (hashes >> U64(40)).astype(np.int64) % WORDS, return_counts=True)
        r, b = key // WORDS, key % WORDS
        length = np.sqrt(np.bincount(r, weights=count.astype(float) ** 2, minlength=rows))
        distinct = np.bincount(row[np.unique(row.astype(U64) * U64(0x9E3779B97F4A7C15) ^ hashes, return_index=True)[1]], minlength=rows)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]) if len(hashes) else np.zeros(0, bool)
        of = {k: _per_row(v[raw], at) for k, v in _IS.items()}
        letters, chars = of["upper"] + of["lower"], np.bincount(row, weights=ends - starts, minlength=rows)
        stats = np.stack([
            _ratio(5 * of["symbol"], chars), _ratio(of["digit"], chars), _ratio(of["upper"], letters), _ratio(10 * of["stop"], chars),
            _ratio(10 * of["bang"], chars), _ratio(10 * of["bar"], chars), _ratio(distinct, words), _ratio(chars, 20 * words),
            np.minimum(1.0, np.log1p(words) / 12), _ratio(of["line"], words), _ratio(np.bincount(row, weights=again, minlength=rows), words),
            (words == 0).astype(float), (words < 50).astype(float)], axis=1)
        dense = np.concatenate([stats, meta[i:j]], axis=1)
        n_words = np.bincount(r, minlength=rows)
        sizes[i:j] = n_words + extra
        first = np.cumsum(sizes[i:j]) - sizes[i:j]
        num, val = np.empty(sizes[i:j].sum(), np.int32), np.empty(sizes[i:j].sum(), np.float32)
        place = first[r] + np.arange(len(r)) - (np.cumsum(n_words) - n_words)[r]
        num[place], val[place] = b, count / length[r]
        tail = (first + n_words)[:, None] + np.arange(extra)
        num[tail], val[tail] = WORDS + np.arange(extra), dense
        numbers.append(num)
        values.append(val)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return np.concatenate([[0], np.cumsum(sizes)]), join(numbers, np.int32), join(values, np.float32)


@dataclass
class Machine:
    """Bias, weights and factors of a factorisation machine."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The score before the logistic, by the sum-of-squares identity; every row has features."""
        if len(offsets) < 2:
            return np.zeros(0)
        at = offsets[:-1]
        vx = self.factors[numbers] * values[:, None]
        both = np.add.reduceat(vx, at, axis=0)
        return self.bias + np.add.reduceat(self.weights[numbers] * values, at) + 0.5 * ((both ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), at))


def train(offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray, labels: np.ndarray, size: int, seed: int = 5) -> Machine:
    """Mini-batch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if not 0 < labels.sum() < len(labels):
        m.factors[:] = 0
        return m
    seen_b, seen_w, seen_v = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo: lo + BATCH]
            n = offsets[rows + 1] - offsets[rows]
            first = np.cumsum(n) - n
            take = np.repeat(offsets[rows] - first, n) + np.arange(n.sum())
            num, val = numbers[take], values[take].astype(np.float64)
            vx = m.factors[num] * val[:, None]
            both = np.add.reduceat(vx, first, axis=0)
            z = m.bias + np.add.reduceat(m.weights[num] * val, first) + 0.5 * ((both ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(g, n) * val
            used, at = np.unique(num, return_inverse=True)
            gw = np.bincount(at, weights=each) + L2 * m.weights[used]
            pull = each[:, None] * (np.repeat(both, n, axis=0) - vx)
            gv = np.stack([np.bincount(at, weights=pull[:, k]) for k in range(RANK)], axis=1) + L2 * m.factors[used]
            gb = g.sum()
            seen_b += gb * gb
            seen_w[used] += gw ** 2
            seen_v[used] += gv ** 2
            m.bias -= RATE * gb / np.sqrt(seen_b)
            m.weights[used] -= RATE * gw / np.sqrt(seen_w[used])
            m.factors[used] -= RATE * gv / np.sqrt(seen_v[used])
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        metadata: tuple[str, ...] = (), max_rows: int = MAX_ROWS) -> Machine:
    """Learns ``label`` (0/1) of the documents that ``labels`` (doc_id, label) names."""
    small_batches(docs.sparkSession)
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    names = [f"_m{k}" for k in range(len(metadata))]
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *[F.col(c).cast("double").alias(n) for c, n in zip(metadata, names, strict=True)])
    rows = rows.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text", *names)  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, num, val = features(b.column(2), [b.column(3 + k) for k in range(len(names))])
            at = pa.array(off.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(num)), pa.ListArray.from_arrays(at, pa.array(val))],
                                             ["id", "label", "numbers", "values"])

    # a bounded sample: max_rows ids; repeated rows of an id count once
    got = rows.dropDuplicates(["_id"]).mapInArrow(run, "id long, label int, numbers array<int>, values array<float>").toArrow()
    size = WORDS + STATS + 2 * len(metadata)
    if not len(got):
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)))
    got = got.sort_by("id").combine_chunks()
    num, val = got.column("numbers").combine_chunks(), got.column("values").combine_chunks()
    off = num.offsets.to_numpy().astype(np.int64)
    return train(off - off[0], num.flatten().to_numpy(), val.flatten().to_numpy(), got.column("label").to_numpy().astype(float), size)


def score(docs: DataFrame, model: Machine, text: str = "text", metadata: tuple[str, ...] = (), to: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)))
    place, others = docs.columns.index(text), [docs.columns.index(c) for c in metadata]
    schema = StructType([*docs.schema.fields, StructField(to, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for b in batches:
            z = [machine.margins(*features(b.column(place).slice(i, 64), [b.column(k).slice(i, 64) for k in others])) for i in range(0, b.num_rows, 64)]
            z = np.concatenate(z).astype(np.float64) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    return docs.mapInArrow(run, schema)
