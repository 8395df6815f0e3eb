"""SentencePiece encoding and decoding by streaming Viterbi.

The ids of a text are those of the segmentation into vocabulary pieces with the highest sum of piece scores (of equal
sums the one whose last piece is longest, and so on backwards).  Spaces become the space mark and a text
gets one before its start, as the vocabulary expects; no other normalising, so decoding returns the text
exactly.  A character that no one-character piece covers is written as its UTF-8 byte pieces, at the lowest piece score less
10; so is a space mark that the text itself holds, which keeps it apart from a space.  With a BPE vocabulary (scores are merge
ranks) this is the best-scoring segmentation, not the order of merges.

Both encoders stream: they keep a window of the last MAX positions (MAX: the longest piece), because a piece can reach no
further back.  Of these a position survives while some piece that starts there can still go on, and as soon as the best paths to
all survivors pass one boundary, the piece before it is committed and the window's start moves there.  ``Stream`` takes a text of any
length as it comes.  ``encode_many`` runs many pieces of text in step in numpy, a window each: between words a boundary is known
beforehand (no piece spans it, checked against the vocabulary), so texts are cut there and each distinct cut piece is solved once.
Cut pieces longer than LANE characters, and those whose paths did not meet within a window, go to ``Stream``.

Null or empty text: no ids; decodes to the empty text.  Null ids decode to null.  Repeated rows are encoded each for itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracewise.llm.common import U64, prefix_hash, range_hash, small_batches, spans, utf8

MARK = 0x2581
OWN_MARK = 0x110000  # a space mark of the text itself: no piece has it
LANE = 48
LANES_AT_ONCE = 1 << 15
REMEMBERED = 200_000
PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces as the model lists them: text, score and kind ('normal', 'byte' or 'other') by id."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[str]

    def __post_init__(self) -> None:
        self.by_text = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == "normal"}
        self.byte_id = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == "byte":
                self.byte_id[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.by_text), default=1)
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == "normal" and s > -1e8]
        self.fallback = float(min(normal, default=0.0)) - PENALTY
        known = {c for p in self.by_text for c in p}
        self.known = np.zeros(OWN_MARK + 1, bool)
        self.known[[ord(c) for c in known]] = True
        mark = chr(MARK)
        #: no piece goes on across a word's end
        self.words_apart = not any(b == mark and a != mark for p in self.by_text for a, b in zip(p, p[1:], strict=False))
        #: all starts of pieces: whether a longer piece has them, and the id of the one that they are (-1: none)
        self.open = {p[:k] for p in self.by_text for k in range(1, len(p))}
        items = sorted(self.open | set(self.by_text))
        self.ids = np.array([self.by_text.get(p, -1) for p in items], np.int64)
        self.goes_on = np.array([p in self.open for p in items], bool)
        codes = np.array([ord(c) for p in items for c in p], U64) + U64(1)
        end = np.cumsum([len(p) for p in items], dtype=np.int64)
        self.hashes = range_hash(prefix_hash(codes), end - [len(p) for p in items], end) if len(items) else np.zeros(0, U64)
        self.score_of = np.where(self.ids >= 0, self.scores[self.ids], -np.inf) if len(items) else np.zeros(0)
        self.tables = _two_tables(self.hashes)
        raw = [p.replace(mark, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.cumsum([0, *map(len, raw)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash, the number of its start of a piece in ``ids``, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        for shift, table in self.tables:
            at = table[(hashes >> U64(shift)) & U64(len(table) - 1)]
            hit = (at >= 0) & (self.hashes[at] == hashes)
            out[hit] = at[hit]
        return out


def _two_tables(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Slot tables by different bits of the hash; a piece whose slot is taken goes on to the next table."""
    tables, left = [], np.arange(len(hashes))
    for shift in (0, 20, 40, 10, 30):
        table = np.full(1 << 20, -1, np.int32)
        slot = (hashes[left] >> U64(shift)) & U64(len(table) - 1)
        table[slot[::-1]] = left[::-1]
        tables.append((shift, table))
        left = left[table[slot] != left]
        if not len(left):
            return tables
    raise ValueError("piece hashes collide")


def load(path: str) -> Vocabulary:
    """Reads a SentencePiece model file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in range(n)]
    return Vocabulary([m.id_to_piece(i) for i in range(n)], np.array([m.get_score(i) for i in range(n)], float), kinds)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Stream:
    """Encodes characters as they come; ``feed`` and ``close`` return the ids that are certain by then."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.codes: list[int] = []  # of the characters after ``base``
        self.base = self.done = self.at = 0  # done: the last committed boundary
        self.best: dict[int, float] = {0: 0.0}
        self.back: dict[int, tuple[int, int]] = {}  # boundary -> start and number of its last piece (-1: byte pieces)
        self.first: dict[int, int] = {}  # boundary -> first boundary after ``done`` on its best path
        self.live: list[int] = [0]  # boundaries from which a piece can still go on

    def feed(self, codes: Iterable[int]) -> list[int]:
        out: list[int] = []
        for c in codes:
            self.codes.append(c)
            self.at += 1
            self._step()
            self.live = [p for p in self.live if self._goes_on(p)] + [self.at]
            while self.live[0] > self.done and len({self.first[p] for p in self.live}) == 1:
                out.extend(self._commit(self.first[self.at]))
        return out

    def _goes_on(self, p: int) -> bool:
        return "".join(map(chr, self.codes[p - self.base:])) in self.v.open if OWN_MARK not in self.codes[p - self.base:] else False

    def close(self) -> list[int]:
        out: list[int] = []
        while self.done < self.at:
            out.extend(self._commit(self.first[self.at]))
        return out

    def _step(self) -> None:
        t, v = self.at, self.v
        best, back = -np.inf, (t - 1, -1)
        last = self.codes[-v.longest:]
        single = False
        for n in range(1, min(len(last), t - self.base) + 1):
            start = t - n
            if start < self.done or last[-n] == OWN_MARK:
                break
            i = v.by_text.get("".join(map(chr, last[-n:])))
            if i is None:
                continue
            single |= n == 1
            score = self.best[start] + v.scores[i]
            if score >= best:
                best, back = score, (start, i)
        if not single:
            score = self.best[t - 1] + v.fallback
            if score > best:
                best, back = score, (t - 1, -1)
        self.best[t], self.back[t] = best, back
        self.first[t] = t if back[0] == self.done else self.first[back[0]]

    def _commit(self, to: int) -> list[int]:
        start, i = self.back[to]
        ids = [i] if i >= 0 else _byte_ids(self.v, self.codes[start - self.base])
        for p in range(self.done, to):
            self.best.pop(p, None)
            self.back.pop(p, None)
            self.first.pop(p, None)
        del self.codes[: to - self.base]
        self.done = self.base = to
        for p in range(to + 1, self.at + 1):
            s = self.back[p][0]
            if s >= to:
                self.first[p] = p if s == to else self.first[s]
        return ids


def _byte_ids(v: Vocabulary, code: int) -> list[int]:
    return v.byte_id[list(chr(MARK if code == OWN_MARK else code).encode("utf-8", "surrogatepass"))].tolist()


class Encoder:
    """Encodes many texts; remembers the ids of up to REMEMBERED distinct cut pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[int, bytes] = {}
        self.early = 0  # pieces committed before the end of the cut piece that they are of

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and ids of a text column."""
        data, off = utf8(texts)
        sizes, out = np.zeros(len(off) - 1, np.int64), []
        for i, j in spans(off):
            ids, n = self._span(data[off[i]: off[j]], off[i: j + 1] - off[i])
            sizes[i:j] = n
            out.append(ids)
        return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(out) if out else np.zeros(0, np.int32)

    def _span(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[codes == MARK] = OWN_MARK
        codes[codes == 32] = MARK
        full = np.flatnonzero(np.diff(lead))  # a text with characters gets a mark before it
        codes = np.insert(codes, lead[full], MARK)
        size = np.diff(lead)
        size[full] += 1
        row_at = np.concatenate([[0], np.cumsum(size)])
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        cut = np.zeros(n, bool)
        cut[row_at[:-1][size > 0]] = True
        alone = ~self.v.known[codes]  # in no piece at all
        cut |= alone
        cut[1:] |= alone[:-1]
        if self.v.words_apart:
            cut[1:] |= (codes[1:] == MARK) & (codes[:-1] != MARK)
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        pre = prefix_hash(codes.astype(U64) + U64(1))
        key, place, inverse = np.unique(range_hash(pre, start, end), return_index=True, return_inverse=True)
        keys = key.tolist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [self.known.get(k) for k in keys]
        new = np.array([k for k, x in enumerate(found) if x is None], np.int64)
        if len(new):
            for k, x in zip(new.tolist(), self._solve(codes, pre, start[place[new]], end[place[new]]), strict=True):
                found[k] = self.known[keys[k]] = x
        width = np.array([len(x) // 4 for x in found])
        pool, at = np.frombuffer(b"".join(found), np.int32), np.cumsum(width) - width
        each = width[inverse]
        ids = pool[np.repeat(at[inverse] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        return ids, np.bincount(np.searchsorted(row_at, start, "right") - 1, weights=each, minlength=len(size)).astype(np.int64)

    def _solve(self, codes: np.ndarray, pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        out: list[bytes | None] = [None] * len(start)
        size = end - start
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LANE]
        for lo in range(0, len(order), LANES_AT_ONCE):
            rows = order[lo: lo + LANES_AT_ONCE]
            for k, x in zip(rows.tolist(), self._in_step(codes, pre, start[rows], size[rows]), strict=True):
                out[k] = x
        for k in [k for k, x in enumerate(out) if x is None]:
            s = Stream(self.v)
            out[k] = np.array(s.feed(codes[start[k]: end[k]].tolist()) + s.close(), np.int32).tobytes()
        return out

    def _in_step(self, codes: np.ndarray, pre: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes | None]:
        """The streaming search over many short cut pieces, sorted by size, one position of all at a time.

        ``window`` slots hold the last positions of each lane: best score, start and id of the last piece there, first boundary after
        the committed one, whether a piece can go on from it.  None: paths that did not meet within the window.
        """
        v, n, longest = self.v, len(start), int(size[-1])
        window = min(v.longest, longest) + 1
        best = np.full((window, n), -np.inf)
        came, piece, first = (np.zeros((window, n), np.int32) for _ in range(3))
        live = np.zeros((window, n), bool)
        best[0], live[0] = 0.0, True
        done, lost = np.zeros(n, np.int32), np.zeros(n, bool)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # lane, id, boundary

        def commit(lanes: np.ndarray, at: np.ndarray) -> None:
            """The piece that ends at the boundary ``at`` of the lanes."""
            out.append((lanes, piece[at % window, lanes], at))

        for t in range(1, longest + 1):
            lo = int(np.searchsorted(size, t))  # the lanes from here are at least t long
            s, now = start[lo:], t % window
            top = np.full(n - lo, -np.inf)
            from_, which = np.full(n - lo, t - 1, np.int32), np.full(n - lo, -1, np.int32)
            back = range(1, min(t, window - 1) + 1)
            for m in back:
                slot = (t - m) % window
                those = np.flatnonzero(live[slot, lo:])
                if not len(those):
                    continue
                at = v.find(range_hash(pre, s[those] + (t - m), s[those] + t))
                known = at >= 0
                total = np.where(known, best[slot, lo + those] + v.score_of[at], -np.inf)
                if m == 1:
                    total = np.where(total > -np.inf, total, best[slot, lo + those] + v.fallback)
                    better = total > top[those]
                else:
                    better = (total > -np.inf) & (total >= top[those])
                hit = those[better]
                top[hit], from_[hit] = total[better], t - m
                which[hit] = np.where(known, v.ids[at], -1)[better]
                live[slot, lo + those] = known & v.goes_on[at]
            best[now, lo:], came[now, lo:], piece[now, lo:], live[now, lo:] = top, from_, which, True
            lanes = np.arange(lo, n)
            first[now, lo:] = np.where(from_ == done[lo:], t, first[from_ % window, lanes])
            lanes = lanes[~lost[lo:]]
            while len(lanes):  # those whose survivors' paths all pass the same boundary
                to = first[now, lanes]
                same = done[lanes] < t
                for m in back:
                    slot = (t - m) % window
                    same &= ~live[slot, lanes] | ((first[slot, lanes] == to) & (done[lanes] < t - m))
                lanes, to = lanes[same], to[same]
                commit(lanes, to)
                self.early += np.count_nonzero(size[lanes] > t)
                done[lanes] = to
                for m in (*back[::-1], 0):
                    slot = (t - m) % window
                    ahead = np.flatnonzero(to < t - m)
                    those, origin = lanes[ahead], came[slot, lanes[ahead]]
                    first[slot, those] = np.where(origin == to[ahead], t - m, first[origin % window, those])
            lost[lo:] |= t - done[lo:] >= window - 1
            ended = np.arange(lo, int(np.searchsorted(size, t, "right")))
            at = np.full(len(ended), t, np.int32)
            while len(ended):  # the rest of a lane that ends here, from its last piece back
                go = (at > done[ended]) & ~lost[ended]
                ended, at = ended[go], at[go]
                commit(ended, at)
                at = came[at % window, ended]
        lane, got, last = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((last, lane))
        lane, got, last = lane[order], got[order], start[lane[order]] + last[order] - 1
        spelled = np.flatnonzero(got < 0)
        if len(spelled):
            ids = [_byte_ids(v, int(c)) for c in codes[last[spelled]]]
            extra = np.ones(len(got), np.int64)
            extra[spelled] = [len(x) for x in ids]
            at = np.cumsum(extra) - extra
            wide = np.repeat(got, extra)
            wide[np.concatenate([np.arange(a, a + len(x)) for a, x in zip(at[spelled], ids, strict=True)])] = np.concatenate(ids)
            lane, got = np.repeat(lane, extra), wide
        ends = np.cumsum(np.bincount(lane, minlength=n)) * 4
        raw = got.astype(np.int32).tobytes()
        return [None if gone else raw[a:b] for a, b, gone in zip([0, *ends[:-1].tolist()], ends.tolist(), lost.tolist(), strict=True)]


def decode_many(v: Vocabulary, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of the texts that the ids stand for."""
    size = np.diff(v.raw_at)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    data = v.raw[np.repeat(v.raw_at[ids] - total[:-1], size) + np.arange(total[-1])]
    at = total[offsets]
    full = np.flatnonzero(np.diff(at))
    first = at[full][data[at[full]] == 32]  # the mark before each text
    lost = np.zeros(len(data) + 1, np.int64)
    lost[first + 1] = 1
    keep = np.ones(len(data), bool)
    keep[first] = False
    return at - np.cumsum(lost)[at], data[keep]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids (array<int>) of the whole text to every row (a column of that name is replaced)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(to)
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(to, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for b in batches:
            off, ids = encoder.encode_many(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for to every row (a column of that name is replaced)."""
    spark = encoded.sparkSession
    encoded = encoded.drop(to)
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))
    place = encoded.columns.index(ids)
    schema = StructType([*encoded.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        for b in batches:
            col = b.column(place)
            off = col.offsets.to_numpy().astype(np.int64)
            at, data = decode_many(v, off - off[0], col.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            whole = pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            null = pa.array(np.asarray(col.is_null()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.compute.if_else(null, pa.scalar(None, pa.string()), whole.cast(pa.string()))], names=schema.names)

    return encoded.mapInArrow(run, schema)
