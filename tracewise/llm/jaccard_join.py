"""Similarity self-join of documents on n-gram sets: universe partition, pigeonhole, exact verification.

A document's set holds its distinct SHINGLE-word shingles (lower-cased A-Z; with fewer words the whole sequence is one; without
words it is empty and links with nothing).  Two documents link when  100 * intersection >= percent * union, so sets of s and l
shingles differ in at most ``most_apart(s, l)`` of them.

Sizes fall into bands so wide that partners stand in one band or in neighbouring ones; each band has a scheme that splits the universe of
shingle hashes into segments, more than two partners of the scheme can differ in, with SPARE votes over.  Then partners
have several whole segments in common.  Every set signs each of its segments (the subset of its shingles there) in its own band's
scheme and in that of the band below, and sets that share a signature are candidates.  Packed by bucket of the signature, an
entry takes about 11 bytes (16 where there are more buckets than a set has entries).

A signature of up to SMALL sets gives its pairs.  One that more sets carry (a group of near copies, a passage that many documents
share) gives a star only: each set with the one that meets most others.  Candidates that would join different classes are
verified on whole sets, the best supported of each set first, so that a group of copies costs about a test a member.

Before that, candidates that cannot link are passed over: sets of s and l have as many segments in common as they have beyond
``most_apart(s, l)``, and all of these are small signatures that gave the pair or crowded ones that both carry.

Crowded signatures whose sets are still of several classes are dropped, and paid for with votes: a set loses nothing as long as its
partners must share more segments than it has dropped or empty ones.  Sets that have no such votes left (mostly text that stands
in many documents) go through the second search, among themselves.  Either some segments count double, as a partner is met there
even when it differs by one: sets sign every segment less one shingle, too.  Or, where many segments are dropped, the universe is
split to single shingles, of which a partner lacks few.  Each set allocates its votes to the cheapest segments of the cheaper way, by
the entries that they read.  Sets that ask are gathered in blocks by their most crowded signature, a block meets each set that
one of its members meets once, and the task that holds them counts the shingles that they share; only links that join classes
leave it (``blocks``).  The largest class need not ask, as the others do.

So no link between different classes is lost.  Null ids link with nothing (their component is null); rows with equal ids are
rows of their own; equal sets are one node (told by 128 bits; signatures carry 64 of them, and stand for all nodes that have these)
from the start, whatever their number.  Null and empty texts have
empty sets.  Very long texts are one row of an Arrow batch and one set.  An empty table gives an empty result.  Only the id
and the text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm import blocks
from tracewise.llm.common import U64, binaries, materialise, mix, shuffle_partitions, small_batches, spans, utf8
from tracewise.llm.components import components
from tracewise.llm.minhash import least_set, shingles

PERCENT = 80
SMALL = 8
SPARE = 8  # one vote to spare for so many that are needed
WHOLE, LESS, SINGLE = 0, 1, 2  # what an entry of the second search signs
FLUSH = 500_000
SETS = "doc_id long, n_shingles long, d1 long, d2 long, text_hash long, band int, filled_own int, filled_upper int, spare_own int, spare_upper int"
NEVER = 1 << 20  # votes to spare in a scheme that a set does not sign in
BUCKETS = 2  # for each shuffle partition
PAIRS = "a1 long, b1 long, support long, key long, d1 long, upper boolean, members long"
COUNTS = ("band", "filled_own", "filled_upper", "spare_own", "spare_upper")
_SALT = U64(0xD6E8FEB86659FD93)


def most_apart(s, l, percent: int = PERCENT):
    """Shingles in which linked sets of s and l can differ (those of both that the other lacks)."""
    return s + l - 2 * (-(-percent * (s + l) // (100 + percent)))


class Schemes:
    """Bands of sizes and the segments of their schemes, up to ``largest``."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts, np.int64)
        ends = self.starts[1:] - 1
        apart = (ends + ends * 100 // percent) * (100 - percent) // (100 + percent)
        self.segments = apart + 1 + np.maximum(1, apart // SPARE)

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, "right") - 1

    def apart(self, size: np.ndarray, upper: bool) -> np.ndarray:
        """The most that a set of this size differs from a partner of the scheme: of its own band (and above), or of the band below."""
        other = self.starts[self.band(size)] - 1 if upper else size * 100 // self.percent
        return (size + other) * (100 - self.percent) // (100 + self.percent)


def _segments(row: np.ndarray, h: np.ndarray, band: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct hashes: first place of each non-empty segment, its row, its number, sum of its shingles' values.

    The segment is monotone in the hash, so a segment's shingles stand together.
    """
    seg = ((h >> U64(32)) * schemes.segments[band[row]].astype(U64)) >> U64(32)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])])) if len(h) else np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(h ^ _SALT), first) if len(first) else np.zeros(0, U64)
    return first, row[first], seg[first], sums


def _sign(sums: np.ndarray, seg: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mix(sums + seg * U64(0x9E3779B97F4A7C15) + band.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def _digest(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(n)])
    total = lambda v: np.diff(np.concatenate([[U64(0)], np.cumsum(v)])[at]).view(np.int64)
    return total(mix(h)), total(mix(h ^ U64(0x5851F42D4C957F2D)))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with the row and hash of their shingles and the size of each row's set."""
    for b in batches:
        data, off = utf8(b.column(column))
        for i, j in spans(off):
            row, h = shingles(data[off[i]: off[j]], off[i: j + 1] - off[i])
            yield b.slice(i, j - i), row, h, np.bincount(row, minlength=j - i)


def _both(size: np.ndarray, least: int, schemes: Schemes) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether it is the scheme of the band below, band of the scheme, which rows sign in it)."""
    band = schemes.band(np.maximum(size, 1))
    yield False, band, size >= least
    low = schemes.starts[band] - 1
    yield True, band - 1, (size >= least) & (band > 0) & (100 * low >= schemes.percent * size) & (low >= least)


def sets(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row the size and digest of its set, and in both schemes its segments and the votes that it has to spare."""
    small_batches(docs.sparkSession)
    least = least_set(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, h, n in _texts(batches, 1):
            schemes = Schemes(percent, int(n.max(initial=1)))
            filled, spare = [], []
            for upper, band, signs in _both(n, least, schemes):
                _, at, _, _ = _segments(row, h, np.maximum(band, 0), schemes)
                filled.append(np.bincount(at, minlength=len(n)))
                spare.append(np.where(signs, filled[-1] - schemes.apart(np.maximum(n, 1), upper), NEVER))
            ints = [pa.array(x.astype(np.int32)) for x in (schemes.band(np.maximum(n, 1)), *filled, *spare)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *map(pa.array, _digest(h, n)), b.column(2), *ints], [c.split()[0] for c in SETS.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(text))).mapInArrow(run, SETS)


def _entries(docs: DataFrame, buckets: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The signatures of all sets, packed by bucket: signatures (48 bits), which node of the row, nodes."""
    least = least_set(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, whos, nodes, seen, count = [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            sig, who, node = np.concatenate(signs), np.concatenate(whos), np.concatenate(nodes)
            bucket = ((sig >> U64(32)) * U64(buckets)) >> U64(32)
            order = np.lexsort((sig, bucket))
            sig, who, bucket = sig[order], who[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = []
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(sig)]):
                used, local = np.unique(who[i:j] >> 1, return_inverse=True)
                low = sig[i:j] & U64((1 << 48) - 1)
                rows.append(((low >> U64(16)).astype("<u4").tobytes(), low.astype("<u2").tobytes(), (local << 1 | who[i:j] & 1).astype("<u2").tobytes(), node[used].tobytes()))
            columns = [binaries(list(c)) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *columns], ["bucket", "high", "low", "who", "nodes"])

        for _, row, h, n in _texts(batches, 1):
            d1, d2 = _digest(h, n)
            fresh = np.zeros(len(n), np.int64)  # 1 + the node's number: copies that stand near each other sign once
            for i in np.flatnonzero(n >= least).tolist():
                if (d1[i], d2[i]) not in seen:
                    fresh[i] = seen[d1[i], d2[i]] = len(seen) + 1
            schemes = Schemes(percent, int(n.max(initial=1)))
            new = np.flatnonzero(fresh)
            nodes.append(d1[new])
            for upper, band, those in _both(n, least, schemes):
                keep = (those & (fresh > 0))[row]
                first, at, seg, sums = _segments(row[keep], h[keep], band, schemes)
                signs.append(_sign(sums, seg, band[at]))
                whos.append((fresh[at] - 1) << 1 | int(upper))
                count += len(at)
            if count >= FLUSH or len(seen) >= 30_000:
                if count:
                    yield flush()
                signs, whos, nodes, seen, count = [], [], [], {}, 0
        if count:
            yield flush()

    return docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(text)).mapInArrow(run, "bucket int, high binary, low binary, who binary, nodes binary")


def _bucket(table: pa.Table) -> pa.Table:
    """Pairs of small signatures of a bucket (with how many they share), and the members of crowded ones."""
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    high, low, who, node = get("high", "<u4"), get("low", "<u2"), get("who", "<u2"), get("nodes", "<i8")
    base = np.cumsum([0, *map(len, node)], dtype=np.int32)
    node, same = np.unique(np.concatenate(node), return_inverse=True)
    mine = same.astype(np.int32)[np.concatenate([(w >> 1) + at for w, at in zip(who, base)])]
    sig = np.concatenate(high).astype(np.int64) << 16 | np.concatenate(low)
    upper = np.concatenate(who) & 1 > 0
    del high, low, who, same
    order = np.lexsort((mine, sig))
    sig, mine, upper = sig[order], mine[order], upper[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (mine[1:] != mine[:-1])])
    sig, mine, upper = sig[keep], mine[keep], upper[keep]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    own = np.add.reduceat((~upper).astype(np.int64), start) > 0
    packed = [np.zeros(0, np.int64)]
    for k in range(2, SMALL + 1):
        at = start[(size == k) & own]
        for i in range(k):
            for j in range(i):
                ok = at[~(upper[at + i] & upper[at + j])]
                packed.append(mine[ok + j].astype(np.int64) << 32 | mine[ok + i])
    pair, support = np.unique(np.concatenate(packed), return_counts=True)
    big = np.flatnonzero((size > SMALL) & own)
    at = np.repeat(start[big] - np.concatenate([[0], np.cumsum(size[big])[:-1]]), size[big]) + np.arange(size[big].sum())
    p, c = len(pair), len(at)
    long = pa.int64()
    first = lambda x: pa.concat_arrays([pa.array(x, long), pa.nulls(c, long)])
    last = lambda x, kind=long: pa.concat_arrays([pa.nulls(p, kind), pa.array(x, kind)])
    return pa.table({"a1": first(node[pair >> 32]), "b1": first(node[pair & 0xFFFFFFFF]), "support": first(support),
                     "key": last(sig[at] ^ (table.column("bucket")[0].as_py() << 48)), "d1": last(node[mine[at]]),
                     "upper": last(upper[at], pa.bool_()), "members": last(np.repeat(size[big], size[big]))})


def _verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, tested on whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(s.as_buffer(), U64), np.frombuffer(t.as_buffer(), U64)
                both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (known.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _hashes(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rep and sorted shingle hashes of the wanted nodes (rep, doc_id, text_hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, h, n in _texts(batches, 1):
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), binaries([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:])])], ["rep", "hashes"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = texts.join(wanted.select("rep", "doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["rep"])
    return rows.select("rep", "text").mapInArrow(run, "rep long, hashes binary")


def _named(labels: DataFrame, as_: str, name: str) -> DataFrame:
    return labels.select(F.col("node").alias(as_), F.col("component").alias(name))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are of different classes."""
    j = pairs.join(_named(labels, "a", "_la"), "a", "left").join(_named(labels, "b", "_lb"), "b", "left")
    return j.filter(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).drop("_la", "_lb")


def similarity_join(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that it reaches by links) of every row."""
    members = materialise(sets(docs, percent, doc_id, text), "sets")
    named = members.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), *[F.first(c).alias(c) for c in COUNTS])
    nodes = materialise(named.select("d1", "d2", "n_shingles", "first.*", *COUNTS, F.monotonically_increasing_id().alias("rep")), "nodes")
    entries = _entries(docs, BUCKETS * shuffle_partitions(docs.sparkSession), percent, doc_id, text)
    found = materialise(entries.groupBy("bucket").applyInArrow(_bucket, PAIRS), "found")

    small = found.filter("a1 is not null").groupBy("a1", "b1").agg(F.sum("support").alias("support"))
    for x in "ab":
        small = small.join(nodes.select(F.col("d1").alias(f"{x}1"), F.col("rep").alias(x)), f"{x}1")
    small = small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "support")
    crowded = found.filter("key is not null").select("key", "d1", "upper", "members").join(nodes.select("d1", "rep", F.col("n_shingles").alias("n")), "d1")
    crowded = materialise(crowded.select("key", "rep", "n", "upper", "members"), "crowded")
    stars = _stars(crowded, percent)
    both = small.withColumn("small", F.col("support")).unionByName(stars.withColumn("small", F.lit(0).cast("long")))
    both = both.groupBy("a", "b").agg(F.sum("support").alias("support"), F.sum("small").alias("small"))
    carried = materialise(crowded.groupBy("rep").agg(F.count(F.when(~F.col("upper"), 1)).alias("crowds_own"), F.count(F.when(F.col("upper"), 1)).alias("crowds_upper")), "carried")
    pairs = materialise(_possible(both, nodes, carried, percent).select("a", "b", "support"), "pairs")

    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    poor = nodes.select("rep", "spare_own", "spare_upper").join(carried, "rep", "left").na.fill(0, ["crowds_own", "crowds_upper"])
    poor = poor.filter((F.col("crowds_own") >= F.col("spare_own")) | (F.col("crowds_upper") >= F.col("spare_upper"))).select("rep")
    known = materialise(_hashes(docs, nodes.join(ends.unionByName(poor).distinct(), "rep"), doc_id, text), "hashes")
    # the best supported partner of each node first
    sides = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "support").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "support"))
    best = sides.groupBy("x").agg(F.max(F.struct("support", (-F.col("y")).alias("y"))).alias("m")).select("x", (-F.col("m.y")).alias("y"))
    best = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = materialise(_verified(best, known, percent), "links")
    rest = _apart(pairs, components(links))
    links = links.unionByName(materialise(_verified(rest, known, percent), "links"))
    labels = components(links)
    more = _second_search(nodes, crowded, labels, known, percent)
    if more is not None:
        links = links.unionByName(more)
        labels = components(links)
    return _result(members, nodes, labels)


def _stars(crowded: DataFrame, percent: int) -> DataFrame:
    """Each member of a crowded signature with the member that is in most of them."""
    drawn = crowded.groupBy("rep").agg(F.count(F.lit(1)).alias("drawn"))
    centres = crowded.join(materialise(drawn, "drawn"), "rep").groupBy("key").agg(F.max(F.struct("drawn", (-F.col("rep")).alias("c"), "n")).alias("m"))
    centres = materialise(centres.select("key", (-F.col("m.c")).alias("centre"), F.col("m.n").alias("size")), "centres")
    star = crowded.join(centres, "key").filter(_fits(F.col("n"), F.col("size"), percent) & (F.col("rep") != F.col("centre")))
    return star.groupBy(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).agg(F.count(F.lit(1)).alias("support"))


def _fits(s: Column, l: Column, percent: int) -> Column:
    return F.least(s, l) * 100 >= F.greatest(s, l) * percent


def _possible(pairs: DataFrame, nodes: DataFrame, carried: DataFrame, percent: int) -> DataFrame:
    """The pairs that may have enough segments in common: the small signatures that gave them and the crowded ones of both must make up
    for the segments beyond the shingles in which they may differ."""
    of = nodes.select("rep", F.col("n_shingles").alias("n"), "band", "filled_own", "filled_upper").join(carried, "rep", "left")
    of = materialise(of.na.fill(0, ["crowds_own", "crowds_upper"]), "sizes")
    one, two = (of.select(*[F.col(c).alias(x if c == "rep" else f"{c}_{x}") for c in of.columns]) for x in "ab")
    j = pairs.join(one, "a").join(two, "b")
    lower = lambda x, y: F.col(f"band_{x}") > F.col(f"band_{y}")
    of_scheme = lambda what, x, y: F.when(lower(x, y), F.col(f"{what}_upper_{x}")).otherwise(F.col(f"{what}_own_{x}"))
    shared = F.col("small") + F.least(of_scheme("crowds", "a", "b"), of_scheme("crowds", "b", "a"))
    j = j.filter(_fits(F.col("n_a"), F.col("n_b"), percent) & (F.col("a") != F.col("b")))
    return j.filter(shared >= F.greatest(of_scheme("filled", "a", "b"), of_scheme("filled", "b", "a")) - _most_apart(F.col("n_a"), F.col("n_b"), percent))


def _most_apart(s: Column, l: Column, percent: int) -> Column:
    return s + l - 2 * F.ceil(percent * (s + l) / (100 + percent))


def _second_search(nodes: DataFrame, crowded: DataFrame, labels: DataFrame, known: DataFrame, percent: int) -> DataFrame | None:
    """Links of the sets without votes to spare, or None when there are none."""
    label = F.coalesce("label", F.col("rep")).alias("label")
    seen = crowded.join(_named(labels, "rep", "label"), "rep", "left").select("key", "rep", "upper", label)
    open_keys = materialise(seen.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", F.lit(True).alias("open")), "open")
    dropped = crowded.join(open_keys, "key").groupBy("rep", "upper").agg(F.count(F.lit(1)).alias("dropped"))
    scheme = lambda upper, spare: F.struct(F.lit(upper).alias("upper"), F.col(spare).alias("spare"))
    spare = nodes.select("rep", F.explode(F.array(scheme(False, "spare_own"), scheme(True, "spare_upper"))).alias("s")).select("rep", "s.*").filter(F.col("spare") < NEVER)
    poor = spare.join(dropped, ["rep", "upper"], "left").filter(F.coalesce("dropped", F.lit(0)) >= F.col("spare")).select("rep", "upper")
    poor = materialise(poor, "poor")
    if poor.isEmpty():
        return None
    buckets = BUCKETS * shuffle_partitions(nodes.sparkSession)
    entries = poor.join(known, "rep").select("rep", "upper", "hashes").mapInArrow(
        _neighbourhoods(percent, buckets), "rep long, upper boolean, kind int, seg int, key long, need int, n long")
    entries = entries.join(open_keys, "key", "left").join(_named(labels, "rep", "label"), "rep", "left")
    # a dropped segment asks nothing, but others' may
    entries = materialise(entries.withColumn("label", label).withColumn("shut", F.coalesce("open", F.lit(False)) & (F.col("kind") == WHOLE)), "entries")
    lists = materialise(entries.groupBy("key").pivot("kind", [WHOLE, LESS, SINGLE]).count().na.fill(0), "lists")
    read = F.when(F.col("kind") == WHOLE, F.col(str(LESS))).when(F.col("kind") == LESS, F.col(str(WHOLE))).otherwise(F.col(str(SINGLE)) - 1)
    single = F.col("single")
    segs = entries.join(lists, "key").groupBy("rep", "upper", (F.col("kind") == SINGLE).alias("single"), "seg").agg(
        F.max("shut").alias("shut"), F.first("need").alias("need"), F.first("n").alias("n"), F.sum(read).alias("cost")).filter(~F.col("shut"))
    of = Window.partitionBy("rep", "upper", "single")
    # single shingles: all but those that a partner may lack; whole segments: as many doubles as votes are missing
    segs = segs.withColumn("rank", F.row_number().over(of.orderBy("cost", "seg"))).withColumn("votes", F.count(F.lit(1)).over(of))
    must = F.when(single, F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).otherwise(F.col("need") - F.col("votes"))
    segs = segs.withColumn("must", must).filter((F.col("must") <= F.col("votes")) & (F.col("rank") <= F.col("must")))
    ways = segs.groupBy("rep", "upper", "single").agg(F.sum("cost").alias("cost")).groupBy("rep", "upper").agg(F.min(F.struct("cost", "single")).alias("way"))
    chosen = segs.join(ways.select("rep", "upper", "way.single"), ["rep", "upper", "single"]).select("rep", "upper", "single", "seg")
    asks = entries.withColumn("single", F.col("kind") == SINGLE).join(chosen, ["rep", "upper", "single", "seg"]).select("key", "kind", "upper", "rep")
    reps = materialise(_asking(poor, labels), "asking")
    asking = asks.join(blocks.clusters(reps, crowded.select("rep", "key", "members")), "rep")
    asking = materialise(asking.select("key", "kind", "upper", "cluster", "i", "rep"), "asks")
    there = entries.select("key", F.col("kind").alias("kind_y"), F.col("upper").alias("upper_y"), F.col("rep").alias("y"))
    suits = F.when(F.col("kind") == SINGLE, F.col("kind_y") == SINGLE).otherwise((F.col("kind") + F.col("kind_y") == WHOLE + LESS) & ~(F.col("upper") & F.col("upper_y")))
    met = asking.select("key", "kind", "upper", "cluster", "i").distinct().join(there, "key").filter(suits)
    met = materialise(met.select("cluster", "i", F.col("y").alias("rep")).distinct(), "met")
    return materialise(blocks.links(asking, met, known, labels, percent), "links")


def _asking(poor: DataFrame, labels: DataFrame) -> DataFrame:
    """rep of the sets that ask: those outside the largest class."""
    reps = poor.select("rep").distinct().join(_named(labels, "rep", "label"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    largest = reps.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")
    return reps.join(F.broadcast(largest), "label", "left_anti").select("rep")


def _neighbourhoods(percent: int, buckets: int):
    """Of every set its signatures, whole and less one shingle, of all segments, its single shingles, and the votes that it needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def key(sig: np.ndarray) -> np.ndarray:
            bucket = (((sig >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
            return (sig & U64((1 << 48) - 1)).astype(np.int64) ^ (bucket << 48)

        for b in batches:
            for rep, upper, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = np.frombuffer(raw.as_buffer(), U64)
                size = np.array([len(h)])
                schemes = Schemes(percent, len(h))
                band = schemes.band(size) - int(upper)
                first, _, seg, sums = _segments(np.zeros(len(h), np.int64), h, band, schemes)
                each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                scheme = np.full(len(h), band[0])
                whole = key(_sign(sums, seg, scheme[: len(seg)]))
                less = key(_sign(sums[each] - mix(h ^ _SALT), seg[each], scheme))
                counts = [len(whole), len(less), len(h)]
                kind = np.repeat(np.array([WHOLE, LESS, SINGLE], np.int32), counts)
                segs = np.concatenate([seg.astype(np.int32), seg[each].astype(np.int32), np.arange(len(h), dtype=np.int32)])
                same = lambda v, t: pa.array(np.full(len(kind), v, t))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [same(rep, np.int64), same(upper, bool), pa.array(kind), pa.array(segs), pa.array(np.concatenate([whole, less, mix(h).view(np.int64)])),
                     same(int(schemes.apart(size, upper)[0]) + 1, np.int32), same(len(h), np.int64)], ["rep", "upper", "kind", "seg", "key", "need", "n"])

    return run


def _result(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.select(F.col("node").alias("rep"), "component")
    least = materialise(labels.join(nodes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("least")), "classes")
    named = nodes.select("d1", "d2", "n_shingles", "rep", F.col("doc_id").alias("first")).join(labels, "rep", "left").join(least, "component", "left")
    named = materialise(named.select("d1", "d2", "n_shingles", F.coalesce("least", "first").alias("class")), "named")
    out = members.join(named, ["d1", "d2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
