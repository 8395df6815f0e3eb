"""Suffix-array dedup: bytes covered by a 50-byte string that a smaller document also has.

``suffix_array`` is the linear grouping construction.  Suffixes start grouped by first symbol; groups are taken in
descending order.  For each suffix of a group its previous-smaller pointer leads to the nearest earlier suffix of
a lower group, which by that proves to be followed by this group's Lyndon prefix: those suffixes leave their group for a new one just
above it, the more copies follow the higher.  When all groups are done, equal Lyndon prefixes share a group and the
groups are in order; one walk from the smallest suffix up, following the same pointers, puts every suffix at the front
of what is left of its group.  No names are given anew and nothing recurses.

``remove_seen_bytes`` finds repeated 50-byte strings with ``repeats``: runs that repeat as a whole are known by hash;
around the anchors that occur in different runs, the distinct runs are cut out and gathered by anchor.  What no other run of
the anchor shares is trimmed off both ends (lengths from sorted neighbours), and the suffix array of the remaining distinct
strings puts equal 50-byte strings side by side, where the smallest document id among them decides.

Texts are UTF-8 bytes; null: empty.  Matches never cross documents.  Rows with equal ids (repeated rows) don't remove each
other; null ids come after all others.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import binaries
from tracewise.llm.repeats import PART, Search, _slices, repeated

LENGTH = 50
GRAM = 20
EXCERPTS = "anchor long, block int, run long, doc long, ahead int, bytes binary"


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; a shorter suffix stands before those it begins."""
    n = len(text) + 1
    symbols = [-1, *sorted(set(text))]
    number = {c: k for k, c in enumerate(symbols)}
    group = [number[c] for c in text]
    group.append(0)
    members: list[set[int] | None] = [set() for _ in symbols]
    for i, g in enumerate(group):
        members[g].add(i)
    above: list[int] = [*range(1, len(symbols)), -1]  # the next higher group
    below: list[int] = [-1, *range(len(symbols) - 1)]
    done = [False] * len(symbols)
    previous = [-1] * n
    g = len(symbols) - 1
    while g != -1:
        own = sorted(members[g])
        followed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and (group[p] == g or done[group[p]]):
                p = previous[p]
            previous[s] = p
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        done[g] = True
        if followed:
            by_copies: dict[int, dict[int, list[int]]] = {}
            for p, k in followed.items():
                by_copies.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(by_copies, reverse=True):
                for h, moved in by_copies[k].items():
                    if len(moved) == len(members[h]) and not _split_later(by_copies, k, h):
                        continue
                    new = len(members)
                    members.append(set(moved))
                    members[h].difference_update(moved)
                    up = above[h]
                    above.append(up)
                    below.append(h)
                    above[h] = new
                    if up != -1:
                        below[up] = new
                    done.append(False)
                    for p in moved:
                        group[p] = new
        g = below[g]
        while g != -1 and not members[g]:
            g = below[g]
    start = [0] * len(members)
    at, g = 0, 0
    while g != -1:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    start[0] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = previous[s]
    return out[1:]


def _split_later(by_copies: dict[int, dict[int, list[int]]], copies: int, group: int) -> bool:
    """Whether fewer copies also take members of this group (their sets are disjoint, so then it isn't whole)."""
    return any(k < copies and group in of for k, of in by_copies.items())


def _write(block: int, data: np.ndarray, chosen: list[tuple]) -> pa.Table:
    """The chosen runs' bytes, from their first window's start to their last one's end."""
    cols: dict[str, list] = {k: [] for k in ("anchor", "run", "doc", "ahead", "bytes")}
    for x, runs, ids, _, doc in chosen:
        lo, hi = x.begin(x.first[runs]), x.finish(x.last[runs] + LENGTH - 1)
        cols["anchor"].append(x.anchor[runs].view(np.int64))
        cols["run"].append(ids.view(np.int64))
        cols["doc"].append(doc)
        cols["ahead"].append(x.place[runs] - x.first[runs])
        cols["bytes"].extend(data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
    join = lambda k: np.concatenate(cols[k]) if cols[k] else np.zeros(0, np.int64)
    return pa.table({"anchor": pa.array(join("anchor"), pa.int64()), "block": pa.array(np.full(len(cols["bytes"]), block), pa.int32()),
                     "run": pa.array(join("run"), pa.int64()), "doc": pa.array(join("doc"), pa.int64()),
                     "ahead": pa.array(join("ahead"), pa.int32()), "bytes": binaries(cols["bytes"])})


def _shared(columns: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Of each row, how many leading bytes (columns, ``size`` of them valid) it shares with some other row of its anchor."""
    n, width = columns.shape
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = columns
    words = wide.reshape(n, -1, 8).view(">u8").reshape(n, -1)
    order = np.lexsort([size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), anchor])
    rows, lens = wide[order], size[order]
    diff = rows[1:] != rows[:-1]
    common = np.where(diff.any(axis=1), diff.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(lens[1:], lens[:-1]))
    common[anchor[order][1:] != anchor[order][:-1]] = 0
    best = np.maximum(np.append(common, 0), np.append(0, common))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _common(table: pa.Table) -> pa.Table:
    """Of each excerpt's windows, those that a smaller document has: (block, run, first, last) stretches."""
    anchor, doc = table.column("anchor").to_numpy(), table.column("doc").to_numpy()
    ahead = table.column("ahead").to_numpy().astype(np.int64)
    blobs = table.column("bytes").to_pylist()
    size = np.array([len(b) for b in blobs], np.int64)
    n, half = len(blobs), 2 * LENGTH
    right, left = np.zeros((n, half), np.uint8), np.zeros((n, half), np.uint8)
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(flat)) - begin[row] - ahead[row]
    behind = at >= 0
    right[row[behind], at[behind]] = flat[behind]
    left[row[~behind], -1 - at[~behind]] = flat[~behind]
    lo, hi = ahead - _shared(left, ahead, anchor), ahead + _shared(right, size - ahead, anchor)
    live = np.flatnonzero(hi - lo >= LENGTH)
    order = live[np.argsort(anchor[live], kind="stable")]
    found: list[tuple[int, int, int]] = []
    for _, s in _slices(anchor[order]):
        found.extend(_repeats_of(order[s].tolist(), blobs, lo, hi, doc))
    out = np.array(found, np.int64).reshape(-1, 3)
    return pa.table({"block": table.column("block").take(pa.array(out[:, 0])), "run": table.column("run").take(pa.array(out[:, 0])),
                     "first": pa.array(out[:, 1], pa.int32()), "last": pa.array(out[:, 2], pa.int32())})


def _repeats_of(rows: list[int], blobs: list[bytes], lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last): stretches of windows of one anchor's excerpts that a smaller document has."""
    least: dict[bytes, int] = {}
    cut = {}
    for r in rows:
        cut[r] = blobs[r][lo[r]: hi[r]]
        least[cut[r]] = min(least.get(cut[r], doc[r]), doc[r])
    strings = sorted(least, key=least.get)
    marked: dict[bytes, list[tuple[int, int]]] = {s: [] for s in strings}
    owner = {}  # window -> smallest id, for every window of every distinct string
    if len(strings) > 1:
        text: list[int] = []
        of, where = [], []
        for k, s in enumerate(strings):
            text.extend(b + 1 for b in s)
            text.append(0)
            of.extend([k] * (len(s) + 1))
            where.extend(range(len(s) + 1))
        joined = b"".join(strings)
        base = np.cumsum([0, *(len(s) for s in strings)]).tolist()
        before, together = b"", []

        def settle() -> None:
            smallest = min(least[strings[k]] for k, _ in together)
            for k, p in together:
                if least[strings[k]] > smallest:
                    owner[k, p] = smallest

        for i in suffix_array(text):
            k, p = of[i], where[i]
            if p + LENGTH > len(strings[k]):
                continue
            window = joined[base[k] + p: base[k] + p + LENGTH]
            if window != before and together:
                settle()
                together = []
            before = window
            together.append((k, p))
        if together:
            settle()
    for k, p in sorted(owner):
        stretches = marked[strings[k]]
        if stretches and stretches[-1][1] == p - 1:
            stretches[-1] = (stretches[-1][0], p)
        else:
            stretches.append((p, p))
    out = []
    for r in rows:
        s = cut[r]
        base_at = int(lo[r])
        if doc[r] > least[s]:
            out.append((r, base_at, base_at + len(s) - LENGTH))
        else:
            out.extend((r, base_at + a, base_at + b) for a, b in marked[s])
    return out


def _pack(table: pa.Table) -> pa.Table:
    out = np.zeros(len(table), PART)
    for c in ("first", "last"):
        out[c] = table.column(c).to_numpy()
    out["run"] = table.column("run").to_numpy().view(np.uint64)
    return pa.table({"block": table.column("block").slice(0, 1), "parts": binaries([out.tobytes()])})


def _resolve(excerpts: DataFrame, blocks: int) -> DataFrame:
    found = excerpts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).groupBy("bucket").applyInArrow(
        _common, "block int, run long, first int, last int")
    return found.groupBy("block").applyInArrow(_pack, "block int, parts binary")


def remove_seen_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry, n_bytes, n_removed, spans (maximal removed runs of bytes, end exclusive), kept (binary) of every row."""
    search = Search("byte", LENGTH, GRAM, smaller=True)
    out = repeated(docs, search, _write, EXCERPTS, _resolve, doc_id, text, carry)
    return out.withColumn("n_bytes", F.col("n_units")).drop("n_units")
