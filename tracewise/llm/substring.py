"""Substring dedup by Rabin-Karp hashes of fixed-length word windows.

Every window of ``window`` words is hashed by prefix sums modulo 2**64; windows are counted over the whole
corpus, and each word covered by a window that occurs more than once goes.  Overlapping and touching windows
merge into maximal removal intervals.

Counting is spared where the answer is known: a window whose anchor (see ``repeats``) is unique occurs
once, and a run of windows that occurs as a whole elsewhere occurs twice; the window hashes of all other runs are
written out, each distinct run once with its weight, and counted with one Spark aggregation.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they stand.  Null or empty text: no words, nothing removed.  Texts shorter
than a window stay whole.  Repeated rows are documents of their own, so they remove each other.  Null ids are kept.  Long texts are
handled in pieces of whole documents (a longer one alone).  An empty table gives an empty result.  ``carry`` columns come back under their own
names unless the result has one of that name; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import binaries, prefix_hash, range_hash
from tracewise.llm.repeats import PART, Search, repeated

WINDOW = 35
GRAM = 8
WINDOWS = "hash long, weight int, block int, run long, at int"


def _window_hashes(search: Search) -> Callable[[int, np.ndarray, list[tuple]], pa.Table]:
    def write(block: int, data: np.ndarray, chosen: list[tuple]) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for x, runs, ids, twice, _ in chosen:
            n = x.last[runs] - x.first[runs] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(x.first[runs], n) + at
            values = (range_hash(prefix_hash(x.symbols), p, p + search.window).view(np.int64), np.repeat(1 + twice, n), np.repeat(ids.view(np.int64), n), at)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        hashes, weight, run, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        return pa.table({"hash": pa.array(hashes, pa.int64()), "weight": pa.array(weight, pa.int32()), "block": pa.array(np.full(len(run), block), pa.int32()),
                         "run": pa.array(run, pa.int64()), "at": pa.array(at, pa.int32())})

    return write


def _pack(table: pa.Table) -> pa.Table:
    """The repeated windows of one block as stretches of neighbours."""
    run, at = table.column("run").to_numpy(), table.column("at").to_numpy()
    order = np.lexsort((at, run))
    run, at = run[order], at[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)]) if len(run) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    out = np.zeros(len(begin), PART)
    out["run"], out["first"], out["last"] = run[begin].view(np.uint64), at[begin], at[np.append(begin[1:], len(run)) - 1]
    return pa.table({"block": table.column("block").slice(0, 1), "parts": binaries([out.tobytes()])})


def _count(windows: DataFrame, blocks: int) -> DataFrame:
    counted = windows.groupBy("hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("hash")
    once = windows.filter("weight = 1").select("hash", "block", "run", "at")
    return once.join(counted, "hash").groupBy("block").applyInArrow(_pack, "block int, parts binary")


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                            carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """doc_id, carry, n_words, n_removed, spans (word numbers, maximal, end exclusive), kept_text of every row.

    ``kept_text`` is the kept words joined by one space; with ``keep_layout`` the text without the removed words and the
    white space behind each.
    """
    search = Search("word", window, min(gram, window), smaller=False)
    out = repeated(docs, search, _window_hashes(search), WINDOWS, _count, doc_id, text, carry, keep_layout)
    return out.withColumn("n_words", F.col("n_units")).drop("n_units").withColumn("kept_text", F.col("kept").cast("string")).drop("kept")
