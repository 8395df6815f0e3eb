"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct SHINGLE-word shingles (lower-cased A-Z; a text of fewer words is one shingle; without
words the set is empty and links with nothing).  Documents whose sets have  intersection >= share * union  are linked,
and components of links are classes.

Sketch: a shingle's hash names one of REGISTERS buckets; a bucket keeps its smallest remainder, compressed to the count of
leading zeros and MANTISSA bits behind them (16 bits a register).  Empty registers borrow from others by a fixed
random order for banding.  Equal sets are one representative from the start (128-bit set digest).  Bands of registers give
candidates, as long as a pair at the threshold is missed with a probability of at most MISS: at 0.85 42 bands of 6, which miss
(1 - 0.85**6)**42 = 2e-9; at 0.80 51 bands of 5, which miss (1 - 0.8**5)**51 = 2e-9.  Candidates pass
if the estimated Jaccard likeness, corrected for chance collisions of compressed registers, is within SIGMAS standard
errors of the threshold, and are confirmed on full shingle sets.

No bucket emits all its pairs.  Members of small ones (up to SMALL) meet each other, so at most SMALL partners a
member.  In larger ones all members first meet one centre (the member that shares most with others), which joins most of a group of
copies.  Buckets that still hold several classes are then settled inside tasks: members outside the bucket's
largest class are compared on full sets with all its members through an index of shingles, and only links that join
classes leave the task (``blocks``; after the sketch only shingle hashes move, no texts).  So no link between different
classes is lost, and rows grow with the members, not with their pairs.

Null ids link with nothing (component null, kept).  Rows with equal ids are rows of their own: representatives are numbered by
set, and ids come back only in the result.  Null text: no words.  Very long texts are one row of a batch and one sketch; ties of the
smallest id go by the text's hash; an empty table gives an empty result.  Only the id and the text are read, so further columns
and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm import blocks
from tracewise.llm.common import U64, binaries, mix, prefix_hash, range_hash, small_batches, spans, utf8, word_hashes, word_spans, materialise
from tracewise.llm.components import components

SHINGLE = 5
REGISTERS = 256
MANTISSA = 10
MISS = 1e-8
SMALL = 8
SIGMAS = 5.0
SKETCHES = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, text_hash long"
TRIES = 160
_BORROW = np.random.default_rng(11).integers(0, REGISTERS, (TRIES, REGISTERS))
_BAND = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xC6BC279692B5C323)) | U64(1)


def least_set(percent: int) -> int:
    """The smallest set that can link with another one than itself: n shingles in common with one of n + 1."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 31


def banding(percent: int) -> tuple[int, int]:
    """Bands and registers of a band: the longest bands that miss a pair at the threshold with at most MISS, else single registers."""
    for rows in range(REGISTERS, 1, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row and hash."""
    starts, ends = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at)
    pre = prefix_hash(hashes)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), n)
    begin = at[:-1][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    h = range_hash(pre, begin, np.minimum(begin + size, at[1:][row]))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def registers(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) compressed registers of sorted distinct shingles; 0: empty."""
    bucket = (h >> U64(56)).astype(np.int64)
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]) if len(h) else np.zeros(0, bool)
    rest = ((h[first] << U64(8)) >> U64(12)).astype(np.int64)  # 52 bits; the first of a bucket is its least
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = 52 - length
    mantissa = ((rest << np.minimum(zeros + 1, 52)) & ((1 << 52) - 1)) >> (52 - MANTISSA)
    out = np.zeros((n, REGISTERS), np.uint16)
    out[row[first], bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out


def filled(reg: np.ndarray) -> np.ndarray:
    """Registers in which every empty one has borrowed a filled one's value, in an order fixed for all documents."""
    out = reg.copy()
    r, c = np.nonzero(reg == 0)
    for t in range(TRIES):
        if not len(r):
            return out
        got = reg[r, _BORROW[t, c]]
        ok = got > 0
        out[r[ok], c[ok]] = got[ok]
        r, c = r[~ok], c[~ok]
    for k in range(1, REGISTERS):
        if not len(r):
            break
        got = reg[r, (c + k) % REGISTERS]
        ok = got > 0
        out[r[ok], c[ok]] = got[ok]
        r, c = r[~ok], c[~ok]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two sets of n and m other elements are equal by chance."""
    a, b = np.maximum(n, 1) / REGISTERS, np.maximum(m, 1) / REGISTERS
    z = np.arange(50)[:, None]
    both = a + b
    return (a * b / both * (np.exp(-both * 2.0 ** -(z + 1)) - np.exp(-both * 2.0 ** -z)) * 2.0 ** -(z + 1 + MANTISSA)).sum(axis=0)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard likeness of register rows, and the number of registers that it rests on."""
    used = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(used, 1)
    c = chance(n, m)
    return np.clip((same - c) / (1 - c), 0, 1), used


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), registers and hash of the text of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for i, j in spans(off):
                row, h = shingles(data[off[i]: off[j]], off[i: j + 1] - off[i])
                n = np.bincount(row, minlength=j - i)
                total = lambda v: np.diff(np.concatenate([[U64(0)], np.cumsum(v)])[np.concatenate([[0], np.cumsum(n)])]).view(np.int64)  # noqa: E731,B023
                reg = registers(row, h, j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(total(mix(h))), pa.array(total(mix(h ^ U64(0x5851F42D4C957F2D)))),
                                                  binaries([x.tobytes() for x in reg]), b.column(2).slice(i, j - i)], ["doc_id", "n_shingles", "d1", "d2", "sketch", "text_hash"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(text))).mapInArrow(run, SKETCHES)


def _registers_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reg = filled(_registers_of(b.column(1)))[:, : bands * rows].reshape(-1, bands, rows).astype(U64)
            key = mix((reg * _BAND[:rows]).sum(axis=2, dtype=U64) + np.arange(1, bands + 1, dtype=U64) * U64(0x9FB21C651E98DF25))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["key", "rep"])

    return run


def _hopeful(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                like, used = estimate(_registers_of(b.column(2)), _registers_of(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy())
                keep = like >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(used, 1))
                yield b.select([0, 1]).filter(pa.array(keep))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(s.as_buffer(), U64), np.frombuffer(t.as_buffer(), U64)
                both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) -> rep and the sorted shingle hashes of the text."""
    for b in batches:
        data, off = utf8(b.column(1))
        for i, j in spans(off):
            row, h = shingles(data[off[i]: off[j]], off[i: j + 1] - off[i])
            at = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), binaries([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:])])], ["rep", "hashes"])


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the class), kept (whether it is that one) of every row."""
    share = percent / 100
    sk = materialise(sketches(docs, doc_id, text), "sketches")
    groups = sk.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # a table of its own, so that Spark can split the joins' large partitions and the numbers stay
    groups = materialise(groups.select("d1", "d2", "n_shingles", "first.*", F.monotonically_increasing_id().alias("rep")), "groups")
    firsts = groups.select("rep", F.col("doc_id").alias("first"))
    numbers = groups.select("d1", "d2", "n_shingles", "rep", F.col("doc_id").alias("first"))
    members = sk.join(numbers, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep", "first")
    own = ["doc_id", "text_hash", "d1", "d2", "n_shingles"]
    reps = sk.join(groups.filter(F.col("n_shingles") >= least_set(percent)), own).dropDuplicates(own)
    reps = materialise(reps.select("rep", "n_shingles", "sketch"), "reps")
    bands = reps.select("rep", "sketch").mapInArrow(_bands(*banding(percent)), "key long, rep long")
    # written, like all small sides of joins by bucket: then Spark can split a hot bucket's partition of the other side
    buckets = materialise(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    inside = materialise(bands.join(buckets, "key"), "buckets")
    wanted = groups.select("doc_id", "text_hash", "rep").join(inside.select("rep").distinct(), "rep")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("rep", "text")
    sets = materialise(texts.mapInArrow(_hashes, "rep long, hashes binary"), "hashes")

    few = inside.filter(F.col("n") <= SMALL).select("key", "rep")
    pairs = few.select("key", F.col("rep").alias("a")).join(few.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b")
    crowded = inside.filter(F.col("n") > SMALL).select("key", "rep")
    drawn = inside.groupBy("rep").agg(F.sum("n").alias("drawn"))
    crowded = materialise(crowded.join(drawn, "rep"), "crowded")
    centres = crowded.groupBy("key").agg(F.max(F.struct("drawn", (-F.col("rep")).alias("c"))).alias("m")).select("key", (-F.col("m.c")).alias("centre"))
    centres = materialise(centres, "centres")
    star = crowded.join(centres, "key").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    links = _linked(materialise(pairs.unionByName(star).distinct(), "pairs"), reps, sets, share, percent)
    links = materialise(links, "linked")
    labels = components(links)
    more = _settled(crowded.select("key", "rep"), centres, labels, sets, percent)
    return _result(members, components(links.unionByName(materialise(more, "settled"))), firsts)


def _settled(crowded: DataFrame, centres: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of crowded buckets that are not of one class yet: those outside a bucket's largest class ask."""
    named = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    seen = crowded.join(named, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    of = seen.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("classes"))
    of = materialise(of.filter("classes > 1").select("key", F.col("most.label").alias("most"), "members"), "open")
    rows = materialise(seen.join(of, "key"), "unsettled")
    asks = materialise(rows.filter("label <> most").join(centres, "key").select("rep", "key", "centre", "members"), "minor")
    # a group of copies has one centre in nearly all of its buckets, so its members come into few blocks
    placed = blocks.clusters(asks.select("rep").distinct(), asks.select("rep", F.col("centre").alias("key"), "members"))
    asking = materialise(asks.join(placed, "rep").select("key", "cluster", "i", "rep"), "asks")
    met = asking.select("key", "cluster", "i").distinct().join(rows.select("key", "rep"), "key").select("cluster", "i", "rep").distinct()
    return blocks.links(asking, materialise(met, "met"), sets, labels, percent)


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, share: float, percent: int) -> DataFrame:
    one, two = (reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    hopeful = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_hopeful(share), "a long, b long")
    hopeful = materialise(hopeful, "hopeful")
    one, two = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return hopeful.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(_confirm(percent), "a long, b long")


def _result(members: DataFrame, labels: DataFrame, firsts: DataFrame) -> DataFrame:
    """``firsts``: the smallest id (first) of each representative; a class is named by the smallest of all."""
    least = materialise(labels.join(firsts.withColumnRenamed("rep", "node"), "node").groupBy("component").agg(F.min("first").alias("least")), "classes")
    labels = materialise(labels.join(least, "component").select(F.col("node").alias("rep"), "least"), "labels")
    out = members.join(labels, "rep", "left")
    component = F.coalesce("least", "first", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
