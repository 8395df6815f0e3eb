"""Exact links between sets that many signatures bring together, without a row for each pair.

Sets that ask are gathered in blocks of at most ASKING by their most crowded signature, as such sets tend to meet the same others.  A
block is sent each set that one of its members meets once (in parts of at most ANSWERING), and the task that holds them counts
shared shingles through an index; it hands on only links that join classes.  So a group of any size is dealt over tasks, and a
set is sent to a block, not to a partner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import U64

ASKING, ANSWERING = 512, 4096


def clusters(reps: DataFrame, crowds: DataFrame) -> DataFrame:
    """rep, cluster (of ``crowds`` (rep, key, members) its most crowded key; without any, itself) and i, its block there."""
    most = crowds.join(reps, "rep", "left_semi").groupBy("rep").agg(F.max(F.struct("members", "key")).alias("m")).select("rep", F.col("m.key").alias("cluster"))
    reps = reps.join(most, "rep", "left").select("rep", F.coalesce("cluster", "rep").alias("cluster"))
    sizes = reps.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("blocks"))
    return reps.join(sizes, "cluster").select("rep", "cluster", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("i"))


def links(asking: DataFrame, met: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join classes, between the sets that ask (cluster, i, rep) and those that their block meets (cluster, i, rep).

    ``sets``: rep and sorted 64-bit shingle hashes; ``labels``: node and component of the links known so far.
    """
    at = ["cluster", "i"]
    parts = met.groupBy(at).agg(F.ceil(F.count(F.lit(1)) / ANSWERING).alias("parts"))
    own = asking.select(*at, "rep").distinct().join(parts, at)
    own = own.select(*at, F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("j"), "rep", F.lit(True).alias("asks"))
    others = met.join(parts, at).select(*at, F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("j"), "rep", F.lit(False).alias("asks"))
    named = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    dealt = others.unionByName(own).join(sets, "rep").join(named, "rep", "left").select(*at, "j", "rep", "asks", F.coalesce("label", "rep").alias("label"), "hashes")
    return dealt.groupBy(*at, "j").applyInArrow(_joins(percent), "a long, b long").distinct()


def _joins(percent: int):
    """Links of a block that join classes: asking sets against all, by counting the shingles that they share."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, asks, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "asks", "label"))
        raw = [x.as_buffer() for x in table.column("hashes")]
        n = np.array([len(x) // 8 for x in raw])
        _, term = np.unique(np.concatenate([np.frombuffer(x, U64) for x in raw]), return_inverse=True)
        order = np.argsort(term, kind="stable")
        holders, at = np.repeat(np.arange(len(rep)), n)[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
        mine = np.concatenate([[0], np.cumsum(n)])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for q in np.flatnonzero(asks).tolist():
            terms = term[mine[q]: mine[q + 1]]
            size = at[terms + 1] - at[terms]
            both = np.bincount(holders[np.repeat(at[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=len(rep))
            for k in np.flatnonzero((100 * both >= percent * (n[q] + n - both)) & (label != label[q])).tolist():
                x, y = root(int(label[q])), root(int(label[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(int(rep[q]), int(rep[k])), max(int(rep[q]), int(rep[k]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run
