"""Exact per-group positions without one-task-per-group sorts.

``grouped_position`` returns, for every row, its 0-based position within its
group under the order (key, tiebreak), where ``key`` is a uniformly
distributed integer hash in [0, 2^31).  A plain
``row_number() over (partition by group order by key)`` would sort a whole
group in one task, so a group holding a third of all rows would become a
single straggler.  Instead rows are bucketed by the high bits of the key:

1. count rows per (group, bucket)            – partial aggregation
2. exclusive prefix sum of bucket counts     – window over the small count table
3. row_number within (group, bucket)         – windows of ~n/buckets rows
4. position = bucket offset + local rank     – join on (group, bucket)

The result is exactly the global row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 31


def grouped_position(df: DataFrame, group_cols: list[str], key: str, tiebreak: str,
                     bucket_bits: int = 12, out: str = "pos", size_col: str | None = "group_size",
                     bucket=None) -> DataFrame:
    """``bucket`` overrides the default (high bits of a uniform hash key); it
    must be monotone in ``key`` – e.g. ``shiftright(id, 10)`` for dense ids."""
    shift = KEY_BITS - bucket_bits
    bexpr = bucket if bucket is not None else F.shiftright(F.col(key).cast("long"), shift)
    b = df.withColumn("_bucket", bexpr)
    counts = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*group_cols).orderBy("_bucket")
    offs = counts.select(
        *group_cols, "_bucket",
        (F.sum("_cnt").over(wg.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*group_cols)).alias("_gsize"),
    )
    wl = Window.partitionBy(*group_cols, "_bucket").orderBy(key, tiebreak)
    local = b.withColumn("_lr", F.row_number().over(wl) - 1)
    # null group keys must still join: use null-safe equality
    cond = [local[c].eqNullSafe(offs[c]) for c in group_cols] + [local["_bucket"] == offs["_bucket"]]
    j = local.join(offs, cond).select(local["*"], offs["_off"], offs["_gsize"])
    res = j.withColumn(out, (F.col("_off") + F.col("_lr")).cast("long"))
    if size_col:
        res = res.withColumn(size_col, F.col("_gsize").cast("long"))
    return res.drop("_bucket", "_lr", "_off", "_gsize")


def k_smallest_distinct(df: DataFrame, group_cols: list[str], value: str, k: int, salts: int = 64,
                        out: str = "values") -> DataFrame:
    """Per group, the sorted array of the ``k`` smallest distinct values.

    Bounded at every step: distinct (group, value) by partial aggregation;
    each (group, salt) slice keeps its k smallest with a row_number window
    (sorted, spillable, 1/salts of the group per task); the final collect per
    group sees at most k * salts candidates.  A group holding a third of all
    rows never lands in one task or one array.
    """
    d = df.select(*group_cols, value).filter(F.col(value).isNotNull()).distinct()
    d = d.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    w = Window.partitionBy(*group_cols, "_salt").orderBy(value)
    cand = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return cand.groupBy(*group_cols).agg(F.slice(F.array_sort(F.collect_list(value)), 1, k).alias(out))


def global_position(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``key`` (unique, any
    type).  Rows are range-partitioned and sorted inside the partitions; a prefix
    sum over one count per partition turns places into positions.  The sorted rows
    are checkpointed, so every reader sees the same partitions."""
    from tracewise.session import cut_lineage

    rows = cut_lineage(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_off"))  # one row a partition
    return rows.join(offsets, "_part").withColumn(out, F.col("_off") + place).drop("_m", "_part", "_off")
