"""Finding repeated fixed-length windows over a whole corpus: the search that two operators share.

A window is ``window`` consecutive symbols of one document (words or bytes).  Among the ``gram``-symbol
strings inside a window the one with the smallest hash is its anchor (leftmost on ties), so equal windows
have equal anchors at equal distance.  Consecutive windows with one anchor form a run, and a document of n
symbols has about 2n / (window - gram) of them.  The search therefore moves one short record a run, not one
a window:

1. ``_tell``     each block of documents tells, per distinct (anchor, run) pair, how often it has it and the
                 smallest id of a document that has it.  Copies inside a block meet before the shuffle.
2. ``_answer``   per anchor, all blocks' records decide which runs repeat as a whole (equal runs elsewhere), and
                 which anchors occur in different runs; only there can windows repeat while their runs differ.
3. ``_excerpts`` each block writes out the distinct runs of those anchors (``window`` to 2*window symbols each).
4.               the operator finds the repeated windows among these excerpts by its own method.
5. ``_apply``    each block marks its documents' repeated runs and windows.

A window whose anchor occurs nowhere else occurs nowhere else, so nothing is lost.  Blocks are hash
partitions of the documents (about ROWS_A_BLOCK rows and BYTES_A_BLOCK bytes); they are shuffled once and read three times.  Runs are compared by 40 + 56 bits
of hash besides the bits of the bucket.  The longest thing that one task holds is a block,
a bucket of records, or the excerpts of one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import (U64, binaries, byte_symbols, mix, prefix_hash, range_hash, shuffle_partitions, spans, utf8,
                                  word_hashes, word_spans)

ROWS_A_BLOCK, BYTES_A_BLOCK = 2048, 8 << 20
PIECE_BYTES = 1 << 18
ALL, BUT_FIRST, TELL, TWICE = 1, 2, 4, 8
NONE = np.int64(np.iinfo(np.int64).max)  # stands for a null id: after every other
_LOW = U64((1 << 28) - 1)
RECORD = np.dtype([("a", "u1", 5), ("u", "u1", 7), ("twice", "u1"), ("doc", "<i8")])
REPLY = np.dtype([("a", "u1", 5), ("u", "u1", 7), ("what", "u1")])
PART = np.dtype([("run", "<u8"), ("first", "<i2"), ("last", "<i2")])
TOLD, REPLIES = "bucket int, block int, records binary", "block int, replies binary, parts binary"
SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Search:
    """What a window is (``unit`` 'word' or 'byte') and what counts: any other occurrence, or one in a smaller document."""

    unit: str
    window: int
    gram: int
    smaller: bool


@dataclass
class Piece:
    """Some documents of a block: their symbols' byte places, and the runs that their windows form."""

    rows: range
    base: int  # the piece's first byte in the block
    starts: np.ndarray | None  # words only: of each, its first byte in the piece
    ends: np.ndarray | None
    offsets: np.ndarray  # of each document, its first symbol
    doc: np.ndarray  # of each run, its document (row of the block)
    first: np.ndarray  # its first window (symbol)
    last: np.ndarray
    anchor: np.ndarray  # 64-bit hash
    a: np.ndarray  # its 40 bits
    u: np.ndarray  # 56 bits of the run's content
    place: np.ndarray  # the anchor's first symbol
    symbols: np.ndarray | None  # words only

    def begin(self, i: np.ndarray) -> np.ndarray:
        """First byte (in the block) of each symbol; bytes are their own places, so nothing is stored for them."""
        return self.base + (i if self.starts is None else self.starts[i])

    def finish(self, i: np.ndarray) -> np.ndarray:
        """The byte after each symbol."""
        return self.base + (i + 1 if self.ends is None else self.ends[i])


def _lowest(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    span = 1
    while span * 2 <= n:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (n - span)], a[n - span:]) if span < n else a


def pieces(search: Search, text: pa.ChunkedArray) -> Iterator[Piece]:
    data, off = utf8(text)
    w, g = search.window, search.gram
    for i, j in spans(off, PIECE_BYTES):
        raw, row_off = data[off[i]: off[j]], off[i: j + 1] - off[i]
        if search.unit == "word":
            starts, ends = word_spans(raw, row_off)
            symbols = word_hashes(raw, starts, ends)
            offsets = np.searchsorted(starts, row_off)
        else:
            starts = ends = None
            symbols, offsets = byte_symbols(raw), row_off
        n = len(symbols)
        empty = np.zeros(0, np.int64)
        runs = (empty, empty, empty, empty.astype(U64), empty, empty, empty)
        if n >= w:
            pre = prefix_hash(symbols)
            at = np.arange(n - g + 1)
            grams = range_hash(pre, at, at + g)
            place = (_lowest((grams & ~_LOW) | at.astype(U64), w - g + 1) & _LOW).astype(np.int64)
            mark = np.zeros(n + 1, np.int8)
            longer = np.flatnonzero(np.diff(offsets) >= w)
            mark[offsets[longer]] += 1
            np.subtract.at(mark, offsets[longer + 1] - w + 1, 1)
            p = np.flatnonzero(np.cumsum(mark[:n], dtype=np.int8))
            if len(p):
                q = place[p]
                begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                first, last, q = p[begin], p[np.concatenate([begin[1:], [len(p)]]) - 1], q[begin]
                content = range_hash(pre, first, last + w) + (q - first).astype(U64) * U64(0x9FB21C651E98DF25)
                runs = (np.searchsorted(offsets, first, "right") - 1, first, last, grams[q], (grams[q] >> U64(24)).astype(np.int64), (content >> U64(8)).astype(np.int64), q)
        doc, first, last, anchor, a, u, q = runs
        yield Piece(range(i, j), int(off[i]), starts, ends, offsets, doc + i, first, last, anchor, a, u, q,
                    symbols if search.unit == "word" else None)


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def _number(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.reshape(-1).view("<u8").astype(np.int64)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(NONE)).to_numpy(zero_copy_only=False).astype(np.int64) if len(table) else np.zeros(0, np.int64)


def _grouped(order_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys (first is foremost) and, in it, whether a row starts a new key of all but the last."""
    order = np.lexsort(order_by[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in order_by[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _slices(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted key."""
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for lo, hi in zip(at, [*at[1:], len(key)], strict=True):
        yield int(key[lo]), slice(int(lo), int(hi))


def _tell(search: Search, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids = _ids(table)
        got = [(x.anchor, x.a, x.u, ids[x.doc]) for x in pieces(search, table.column("text"))]
        anchor, a, u, doc = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in range(4))
        bucket = (anchor.astype(U64) % U64(buckets)).astype(np.int64)
        order, new = _grouped([bucket, a, u, doc])
        head = order[new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        rec = np.zeros(len(head), RECORD)
        rec["a"], rec["u"], rec["twice"], rec["doc"] = _low_bytes(a[head], 5), _low_bytes(u[head], 7), np.minimum(n, 2), doc[head] if search.smaller else 0
        rows = list(_slices(bucket[head]))
        block = table.column("block")[0].as_py() if len(table) else 0
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                         "records": binaries([_packed(rec[s]) for _, s in rows])})

    return run


def _packed(rec: np.ndarray) -> bytes:
    """Field after field, and the ids byte plane after byte plane, so that the shuffle's compression bites."""
    doc = np.ascontiguousarray(rec["doc"]).view(np.uint8).reshape(-1, 8).T
    return b"".join([rec["a"].tobytes(), rec["u"].tobytes(), rec["twice"].tobytes(), doc.tobytes()])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, u, twice, doc of all records, and the blob that each is from."""
    size = [len(b) // RECORD.itemsize for b in blobs]
    cut = lambda lo, hi: [np.frombuffer(b, np.uint8, (hi - lo) * n, lo * n) for b, n in zip(blobs, size, strict=True)]
    a, u = _number(np.concatenate(cut(0, 5)).reshape(-1, 5)), _number(np.concatenate(cut(5, 12)).reshape(-1, 7))
    twice = np.concatenate(cut(12, 13))
    doc = np.concatenate([x.reshape(8, -1).T.reshape(-1).view("<i8") for x in cut(13, 21)])
    return a, u, twice, doc, np.repeat(np.arange(len(blobs)), size)


def _answer(search: Search) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        a, u, twice, doc, blob = _unpacked(table.column("records").to_pylist())
        owner = block[blob].astype(np.int64)
        order = np.lexsort((owner, doc, u, a))
        a, u, twice, doc, owner = a[order], u[order], twice[order], doc[order], owner[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_u = new_a | np.concatenate([[True], u[1:] != u[:-1]])
        run_no, anchor_no = np.cumsum(new_u) - 1, np.cumsum(new_a) - 1
        total = np.bincount(run_no, weights=twice)[run_no]
        several = np.bincount(anchor_no[new_u])[anchor_no] > 1  # different runs share the anchor
        what = np.zeros(len(a), np.uint8)
        if search.smaller:
            least = doc[np.flatnonzero(new_u)][run_no]
            what[doc > least] |= ALL
            what[(doc == least) & (twice > 1)] |= BUT_FIRST
        else:
            what[total > 1] |= ALL
        what[new_u & several] |= TELL
        what[new_u & several & (total > 1)] |= TWICE
        say = np.flatnonzero(what)
        say = say[np.argsort(owner[say], kind="stable")]
        rep = np.zeros(len(say), REPLY)
        rep["a"], rep["u"], rep["what"] = _low_bytes(a[say], 5), _low_bytes(u[say], 7), what[say]
        rows = list(_slices(owner[say]))
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "replies": binaries([rep[s].tobytes() for _, s in rows]),
                         "parts": pa.nulls(len(rows), pa.binary())})

    return run


def run_id(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """64 bits that stand for an (anchor, run) pair."""
    return mix(mix(a.astype(U64)) ^ u.astype(U64))


class Replies:
    """What a block was told: of each (anchor, run) pair, and of the windows of partly repeated runs."""

    def __init__(self, table: pa.Table):
        blobs = lambda c: b"".join(x for x in table.column(c).to_pylist() if x) if len(table) else b""
        rep, parts = np.frombuffer(blobs("replies"), REPLY), np.frombuffer(blobs("parts"), PART)
        key = run_id(_number(rep["a"]), _number(rep["u"]))
        order = np.argsort(key)
        self.key, self.what = key[order], rep["what"][order]
        self.parts = parts[np.argsort(parts["run"], kind="stable")]

    def find(self, run: np.ndarray) -> np.ndarray:
        """Of each run id, what its reply says (0: none)."""
        if not len(self.key):
            return np.zeros(len(run), np.uint8)
        at = np.minimum(np.searchsorted(self.key, run), len(self.key) - 1)
        return np.where(self.key[at] == run, self.what[at], 0).astype(np.uint8)

    def find_parts(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``run``, and its first and last marked window (counted from the run's first), a row a marked stretch."""
        lo, hi = np.searchsorted(self.parts["run"], run), np.searchsorted(self.parts["run"], run, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(run)), n), self.parts["first"][at].astype(np.int64), self.parts["last"][at].astype(np.int64)


def _replied(search: Search, docs: pa.Table, answers: pa.Table) -> tuple[list[tuple[Piece, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], Replies]:
    """Each piece of a block with its replied runs: their numbers, run ids, replies, and whether their document has the
    smallest id of those in the block with that run."""
    replies, ids = Replies(answers), _ids(docs)
    found = []
    for x in pieces(search, docs.column("text")):
        run = run_id(x.a, x.u)
        what = replies.find(run)
        hot = np.flatnonzero(what)
        found.append((x, hot, run[hot], what[hot]))
    run, doc = (np.concatenate([f(y) for y in found]) if found else np.zeros(0, np.int64)
                for f in (lambda y: y[2], lambda y: ids[y[0].doc[y[1]]]))
    order, new = _grouped([run, doc])
    least = np.zeros(len(run), np.int64)
    least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(run) else 0
    at = np.cumsum([0, *(len(y[1]) for y in found)])
    return [(*y, (doc == least)[lo:hi]) for y, lo, hi in zip(found, at, at[1:], strict=False)], replies


def _excerpts(search: Search, write: Callable[[int, np.ndarray, list[tuple]], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, _ = _replied(search, docs, answers)
        data, ids = utf8(docs.column("text"))[0], _ids(docs)
        seen: set[int] = set()
        chosen = []
        for x, hot, run_ids, what, least in found:
            tell = np.flatnonzero(((what & TELL) > 0) & least)
            tell = tell[np.sort(np.unique(run_ids[tell], return_index=True)[1])]
            tell = tell[[r not in seen for r in run_ids[tell].tolist()]]
            seen.update(run_ids[tell].tolist())
            chosen.append((x, hot[tell], run_ids[tell], (what[tell] & TWICE) > 0, ids[x.doc[hot[tell]]]))
        return write(docs.column("block")[0].as_py() if len(docs) else 0, data, chosen)

    return run


def _apply(search: Search, fields: list[str], keep_layout: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, replies = _replied(search, docs, answers)
        data, off = utf8(docs.column("text"))
        n_rows = len(docs)
        n_units, n_removed = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
        spans_of: list[list] = [[]] * n_rows
        kept, kept_size = [], np.zeros(n_rows, np.int64)
        for x, hot, run_ids, what, least in found:
            whole = ((what & ALL) > 0) | (((what & BUT_FIRST) > 0) & ~least)
            rest = hot[~whole]
            part, p0, p1 = replies.find_parts(run_ids[~whole])
            lo = np.concatenate([x.first[hot[whole]], x.first[rest[part]] + p0])
            hi = np.concatenate([x.last[hot[whole]], x.first[rest[part]] + p1]) + search.window
            n = int(x.offsets[-1])
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, lo, 1)
            np.subtract.at(mark, hi, 1)
            gone = np.cumsum(mark)[:-1] > 0
            rows = slice(x.rows.start, x.rows.stop)
            total = np.concatenate([[0], np.cumsum(gone)])
            n_units[rows], n_removed[rows] = np.diff(x.offsets), np.diff(total[x.offsets])
            edge = np.zeros(n + 1, bool)
            edge[x.offsets] = True
            begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])[:n]))
            end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]])[:n])) + 1
            for r, s in _slices(np.searchsorted(x.offsets, begin, "right") - 1):
                base = int(x.offsets[r])
                spans_of[r + x.rows.start] = [{"start": a - base, "end": b - base} for a, b in zip(begin[s].tolist(), end[s].tolist(), strict=True)]
            piece_off = off[x.rows.start: x.rows.stop + 1]
            if search.unit == "byte" or keep_layout:
                # a removed word goes with the space behind it
                stay = np.ones(int(piece_off[-1] - piece_off[0]), bool)
                row_end = piece_off[1:][np.searchsorted(x.offsets, begin, "right") - 1]
                after = np.where(end < n, x.begin(np.minimum(end, max(n - 1, 0))), piece_off[-1]) if n else end
                for a, b in zip(x.begin(begin).tolist(), np.minimum(after, row_end).tolist(), strict=True):
                    stay[a - piece_off[0]: b - piece_off[0]] = False
                kept.append(data[piece_off[0]: piece_off[-1]][stay])
                count = np.concatenate([[0], np.cumsum(stay)])
                kept_size[rows] = np.diff(count[piece_off - piece_off[0]])
            else:
                live = np.flatnonzero(~gone)
                size = x.finish(live) - x.begin(live) + 1
                doc = np.searchsorted(x.offsets, live, "right") - 1
                last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
                size -= last
                begin_out = np.cumsum(size) - size
                from_byte = np.repeat(x.begin(live) - begin_out, size) + np.arange(size.sum())
                out = data[np.minimum(from_byte, max(0, len(data) - 1))]
                out[(begin_out + size - 1)[~last]] = 32
                kept.append(out)
                kept_size[rows] = np.bincount(doc, weights=size, minlength=len(x.rows)).astype(np.int64)
        out = {c: docs.column(c) for c in fields}
        out |= {"n_units": pa.array(n_units), "n_removed": pa.array(n_removed),
                "spans": pa.array(spans_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": _binary(np.concatenate(kept) if kept else np.zeros(0, np.uint8), kept_size)}
        return pa.table(out)

    return run


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)])
    wide = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return wide.cast(pa.binary())


def repeated(docs: DataFrame, search: Search, write: Callable, excerpt_schema: str, resolve: Callable[[DataFrame, int], DataFrame],
             doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """``doc_id``, the ``carry`` columns, n_units, n_removed, spans (of units removed, maximal) and kept (binary) of every row.

    ``write`` turns a block's excerpts into a table of ``excerpt_schema``; ``resolve`` finds the repeated windows among all
    excerpts and returns ``block, parts`` rows (packed PART records).
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    blocks = max(shuffle_partitions(spark), n // ROWS_A_BLOCK, (size or 0) // BYTES_A_BLOCK)
    given = {f"_carry{k}": c for k, c in enumerate(carry) if c != doc_id}  # own names inside, so that none can clash
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(k) for k, c in given.items()])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # the same rows each time, so that one shuffle serves all three reads
    told = rows.groupBy("block").applyInArrow(_tell(search, blocks), TOLD)
    answers = told.groupBy("bucket").applyInArrow(_answer(search), REPLIES)
    excerpts = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_excerpts(search, write), excerpt_schema)
    parts = resolve(excerpts, blocks).select("block", F.lit(None).cast("binary").alias("replies"), "parts")
    both = answers.select("block", "replies", "parts").unionByName(parts)
    fields = ["doc_id", *given]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in fields)
    done = rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        _apply(search, fields, keep_layout), f"{kinds}, n_units long, n_removed long, spans {SPANS}, kept binary")
    own = ["n_units", "n_removed", "spans", "kept"]
    return done.select(F.col("doc_id").alias(doc_id), *[F.col(k).alias(c) for k, c in given.items() if c not in own], *own)
