"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the hashed 1- to 3-grams of all training texts, by language, in Spark (each task adds up
its rows, then one sum per language and bucket); the log-probability matrix (languages x BUCKETS, so bounded
by the number of languages) is sent to the tasks, which score whole texts in numpy: one gather per n-gram and
one sum per text.

Characters are lower-cased one by one; any run breaker that is not a letter counts as a space, and n-grams
without a letter are skipped.  Null text, or no letter: ``und`` with score 0 and no evidence.  Rows without language don't
train.  With no training rows at all every text is ``und``.  Ties go to the language first by code point.
Repeated rows count as often as they stand; other columns pass through untouched, but columns of the
names that an operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracewise.llm.common import materialise, small_batches, spans, utf8

BUCKETS = 1 << 15
ORDERS = 3
SMOOTHING = 0.5
BLOCK = 1 << 19
HELD_LANGUAGES = 128
MOST_LANGUAGES = 2048  # the matrix that reaches driver and tasks has a column each
UNKNOWN = "und"

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case letter, or a space; and whether it is a letter."""
    if not _TABLES:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                k = s.lower()
                low[c] = ord(k) if len(k) == 1 else c
        _TABLES["low"], _TABLES["letter"] = low, low != 32
    return _TABLES["low"], _TABLES["letter"]


def _grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Blocks of a text column: first and last row, each position's row, its n-gram buckets by order, its letter flag."""
    data, off = utf8(col)
    low, letter = _letters()
    for i, j in spans(off):
        raw = data[off[i]: off[j]]
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = lead[off[i: j + 1] - off[i]]
        code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(i, j), np.diff(at))
        for lo in range(0, len(code), BLOCK):
            hi = min(len(code), lo + BLOCK)
            back = min(lo, ORDERS - 1)
            c, r = low[code[lo - back: hi]], row[lo - back: hi]
            ok = letter[code[lo - back: hi]]
            h = c * np.uint32(0x9E3779B1)
            out, any_letter = [], ok.copy()
            for n in range(1, ORDERS + 1):
                if n > 1:
                    prev, same = np.zeros_like(c), np.zeros(len(c), bool)
                    prev[n - 1:], same[n - 1:] = c[: len(c) - n + 1], r[n - 1:] == r[: len(r) - n + 1]
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + prev * np.uint32(0xC2B2AE3D)
                    before = np.zeros(len(c), bool)
                    before[n - 1:] = ok[: len(c) - n + 1]
                    any_letter = any_letter | (before & same)
                    valid = same & any_letter
                else:
                    valid = ok
                b = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int32)
                b[~valid] = BUCKETS  # the row of the matrix that is all zero
                out.append(b[back:])
            yield i, j, r[back:], out, ok[back:]


@dataclass
class Model:
    """Languages in code point order and the matrix (BUCKETS + 1, languages) of log probabilities; the last row is zero."""

    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row of ``train`` with a text and a language."""
    small_batches(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cols = [(k, np.flatnonzero(v), v) for k, v in held.items()]
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, b, _ in cols for _ in range(len(b))], pa.string()),
                pa.array(np.concatenate([b for _, b, _ in cols]).astype(np.int32)),
                pa.array(np.concatenate([v[b] for _, b, v in cols]))], ["lang", "bucket", "n"])

        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            sums = np.zeros((len(names), BUCKETS + 2), np.int64)
            sums[:, BUCKETS + 1] = np.bincount(code, minlength=len(names))
            for _, _, row, grams, _ in _grams(batch.column(0)):
                key = code[row].astype(np.int64) * (BUCKETS + 2)
                for b in grams:
                    sums += np.bincount(key + b, minlength=sums.size).reshape(sums.shape)
            sums[:, BUCKETS] = 0
            for k, v in zip(names, sums, strict=True):
                held[k] = held[k] + v if k in held else v
            if len(held) > HELD_LANGUAGES:
                yield out()
                held = {}
        if held:
            yield out()

    rows = train.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    sums = materialise(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    if sums.filter(F.col("bucket") == BUCKETS + 1).limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    sums = sums.toArrow()
    codes = sums.column("lang").combine_chunks().dictionary_encode() if len(sums) else pa.array([], pa.string()).dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    names = codes.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i])
    n = np.zeros((len(names), BUCKETS + 2))
    n[codes.indices.to_numpy(zero_copy_only=False), sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    n = n[order]
    docs, grams = n[:, BUCKETS + 1], n[:, :BUCKETS] + SMOOTHING
    logp = np.zeros((BUCKETS + 1, len(names)), np.float32)
    logp[:BUCKETS] = (np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))).T
    return Model([names[i] for i in order], logp, np.log((docs + 1) / (docs.sum() + max(1, len(names)))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds to every row ``lang_pred``, ``score`` (the posterior of that language, 0 for ``und``) and ``evidence``: by how much the log
    probability of an n-gram of the text in that language is above that of a bucket drawn at random, on average.  The posterior
    only tells the known languages from each other; the evidence falls below 0 where none of them fits."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior))
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("evidence", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp, prior = shared.value
        for batch in batches:
            n, k = batch.num_rows, len(names)
            total, known, size = np.tile(prior, (n, 1)), np.zeros(n, bool), np.zeros(n)
            for _, _, row, grams, ok in _grams(batch.column(place)):
                if not len(row):
                    continue
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                known[row[ok]] = True
                for b in grams:
                    size += np.bincount(row[b < BUCKETS], minlength=n)
                if k:
                    part = logp[grams[0]]
                    for b in grams[1:]:
                        part += logp[b]
                    total[row[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
            if k:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                share = np.where(known, share, 0.0)
                evidence = (total[np.arange(n), best] - prior[best]) / np.maximum(size, 1) + np.log(BUCKETS)
            else:
                pred, share, evidence = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            none = np.array([p == UNKNOWN for p in pred], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(share), pa.array(evidence, mask=none)], names=schema.names)

    return docs.mapInArrow(score, schema)
