"""Mixing sources to target weights by weighted random keys (Efraimidis-Spirakis).

``source_targets`` turns source weights into word targets: all sources share ``budget`` times the
whole size by weight; a target stops at ``max_epochs`` times its source's size and the excess is
reshared by weight until none is above.  With the sources in order of size/weight that has a closed
form (the stopped ones are a prefix), computed with running sums over one row per source.

``mix_sources`` takes ``floor(target / source_size)`` complete epochs of every document, then the
documents with the smallest keys ``-ln(u) / weight`` until their sizes fill the remaining budget;
``u`` is a hash of the id, so reruns agree.  The order within a source is never one sort: keys fall
into BINS ranges per source (a monotone map of the key), the bins' sizes are prefix-summed (at most
BINS rows per source), and only the bin in which the budget ends is ranked row by row.
A document crossing the budget is taken where that brings the sum nearer to the budget.

Nulls: a null text has size 0; a null source is a source of its own, last in order; null ids share
one hash and are ranked by content.  Ties in key are broken by id, then size.  Repeated rows are rows
of their own.  An empty table gives an empty result.  Texts are counted whole, in the JVM.  Only the named columns are read; ``carry``
names must not be those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewise.llm.common import SPACES, materialise

BINS = 4096
CYCLE = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words of a text, without building filtered arrays."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
            - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight in [0.5, 1]: half plus half the share of the text's bytes that are not digits or symbols (null or empty: 0.5)."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(F.translate(t, "0123456789#*$%&|<>{}[]=+_~^\\/@", ""))
    return 0.5 + 0.5 * F.coalesce(F.try_divide(plain.cast("double"), F.octet_length(t)), F.lit(0.0))


def source_targets(sizes: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """``sizes``: one row per source (source, source_size) -> adds ``target`` (double)."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (nth % len(cycle) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("_w")).withColumn("_cap", F.col("source_size") * max_epochs)
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("_all", F.sum("source_size").over(whole) * budget)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    # the first source (by ratio) whose cap is above the level that the rest can have sets the level for all after it
    t = t.withColumn("_level", level)
    t = t.withColumn("_final", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", F.col("_level")))).over(whole))
    free = F.col("_final").isNotNull() & (F.col("_ratio") >= F.col("_final._ratio"))
    return t.select("source", "source_size", F.when(free, F.least("_cap", F.col("_w") * F.col("_final._level")))
                    .otherwise(F.col("_cap")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, cycle: tuple[float, ...] = CYCLE,
                text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, weight, copies, taken and the ``carry`` columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       quality_weight(F.col(text)).alias("weight"), u.alias("_u"), *carry)
    rows = rows.withColumn("_key", -F.log("_u") / F.col("weight"))
    # exp(-key) falls from 1 to 0 as the key grows: equal-width bins of it are even for weight 1 and ordered for all
    rows = rows.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("_key"))) * BINS)).cast("int")).drop("_u")
    rows = materialise(rows, "mix")
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_n"))
    sizes = bins.groupBy("source").agg(F.sum("_n").alias("source_size"))
    plan = source_targets(sizes, budget, max_epochs, cycle)
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
    plan = plan.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size")))
    run = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    plan = plan.withColumnRenamed("source", "_s").join(bins.withColumnRenamed("source", "_bs"), F.expr("_s <=> _bs"))
    plan = plan.select("_s", F.col("_bin").alias("_b"), "source_size", "target", "_epochs", "_rest", "_before", "_n")
    r = rows.join(plan, F.expr("source <=> _s and _bin = _b"))
    inside = F.col("_before") + F.col("_n") <= F.col("_rest")
    edge = ~inside & (F.col("_before") < F.col("_rest"))
    ranked = W.partitionBy("source", "_bin").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    cut = (r.filter(edge).withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(ranked), F.lit(0)))
           .withColumn("_more", (F.col("_at") + F.col("size") / 2 <= F.col("_rest")).cast("int")).drop("_at"))
    rest = r.filter(~edge).withColumn("_more", inside.cast("int"))
    copies = (F.col("_epochs") + F.col("_more")).cast("int")
    return rest.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", "weight", copies.alias("copies"),
                                        (copies * F.col("size")).cast("long").alias("taken"), *carry)
