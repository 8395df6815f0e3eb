"""Shared helpers of the training-data operators.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  Texts reach Python as Arrow buffers and are
handled in chunks of a few MB, so memory does not grow with a batch of long documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.session import checkpoint_dir
from tracewise.sources.tables import table

SPACES = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
ARROW_ROWS = 512
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Hand at most ARROW_ROWS rows at a time to Python, so that long texts fit (only ever lowers the setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts lineage, computes once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda variable, so higher-order bodies don't recompute it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


# --- numpy side -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = []
        for b in (_BASE, _BASE_INV):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[0] = have = (out[0], out[1])
    return have


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums modulo 2**64 of 64-bit symbols; feed to ``range_hash``."""
    p, _ = _powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * p[: len(symbols)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end]; equal sequences have equal hashes wherever they stand."""
    _, inv = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a row's end ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    return np.flatnonzero(word & (before | edge[:-1])), np.flatnonzero(word & (after | edge[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, block: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each word, block by block (blocks end at word ends)."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi]
        pre = prefix_hash(_BYTE[_LOWER[part] if lower else part])
        out[i:j] = range_hash(pre, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
