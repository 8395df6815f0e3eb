"""Hallucination pattern mining.

Patterns are derived, never stored with their statistics: the store is the
extracted-occurrence table grouped by pattern_id, and every statistic is a
``groupBy`` over it (IO9: stats rebuilt on load).  Insertion order of the
reference (chains in input order, steps in order) is modelled by the
occurrence position (chain_order, idx); "first" always means smallest
position, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import r6, safe_div
from tracewise.functions.ranking import k_smallest_distinct

MAX_EXAMPLES = 5


def extract_occurrences(steps: DataFrame, chain_order: str = "chain_id", description_chars: int | None = None,
                        example_chars: int | None = None) -> DataFrame:
    """One row per wrong step: pattern_id = model_domain_type_idx, type
    null -> unknown, description 'Error in step i: ' + text, example = text
    (both whole, or cut to the given lengths; 100 and 200 in the reference),
    severity 0.7 for an origin else 0.5."""
    cut = lambda n: F.col("text") if n is None else F.substring("text", 1, n)
    htype = F.coalesce(F.col("error_type"), F.lit("unknown"))
    w = steps.filter(~F.col("is_correct"))
    return w.select(
        F.concat_ws("_", "model_type", "domain", htype, F.col("idx").cast("string")).alias("pattern_id"),
        "model_type", "domain", htype.alias("hallucination_type"),
        F.concat(F.lit("Error in step "), F.col("idx").cast("string"), F.lit(": "), cut(description_chars)).alias("description"),
        cut(example_chars).alias("example"),
        F.when(F.col("is_origin"), F.lit(0.7)).otherwise(F.lit(0.5)).alias("severity"),
        F.struct(F.col(chain_order).alias("c"), F.col("idx").alias("i")).alias("first_seen"),
    )


def pattern_store(occ: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Merge occurrences by pattern_id: frequency = occurrences; the first
    occurrence's severity and description; up to ``max_examples`` distinct examples
    (sorted, so the choice is deterministic)."""
    base = occ.groupBy("pattern_id", "model_type", "domain", "hallucination_type").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(F.struct("first_seen", "severity", "description")).alias("_f"))
    ex = k_smallest_distinct(occ, ["pattern_id"], "example", max_examples, out="examples")
    return (base.join(ex, "pattern_id", "left")
            .select("pattern_id", "model_type", "domain", "hallucination_type", F.col("_f.description").alias("description"),
                    "frequency", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
                    F.col("_f.severity").alias("severity"), F.col("_f.first_seen").alias("first_seen")))


def _dist(df: DataFrame, keys: list[str], dim: str) -> DataFrame:
    d = df.groupBy(*keys, dim).agg(F.sum("frequency").alias("f"))
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", F.col(dim), F.col("f").cast("string")))), ",").alias(f"{dim}_dist"))


def model_stats(store: DataFrame) -> DataFrame:
    """P5: per model #patterns, total frequency, frequency by type / domain
    and avg_severity = mean(severity*frequency) / sum(frequency) (kept as the
    reference computes it)."""
    g = store.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("total_patterns"), F.sum("frequency").alias("total_frequency"),
        F.avg(F.col("severity") * F.col("frequency")).alias("_m"))
    return (g.join(_dist(store, ["model_type"], "hallucination_type"), "model_type")
            .join(_dist(store, ["model_type"], "domain"), "model_type")
            .select("model_type", "total_patterns", "total_frequency",
                    r6(F.col("_m") / F.col("total_frequency")).alias("avg_severity"),
                    F.col("hallucination_type_dist").alias("type_dist"), F.col("domain_dist")))


def _top(store: DataFrame, dim: str) -> DataFrame:
    """Most frequent value of ``dim`` per model; ties -> first seen."""
    d = store.groupBy("model_type", dim).agg(F.sum("frequency").alias("f"), F.min("first_seen").alias("fs"))
    return d.groupBy("model_type").agg(F.min(F.struct((-F.col("f")).alias("nf"), F.col("fs"), F.col(dim).alias("v"))).alias("t")) \
        .select("model_type", F.col("t.v").alias(f"top_{dim}"))


def vulnerability_profile(store: DataFrame, models: DataFrame) -> DataFrame:
    """Per requested model: vulnerability score sum(f*s)/sum(f), most
    common type and most vulnerable domain (ties -> first inserted); zeros
    and nulls for a model without patterns.  ``models``: (model_type)."""
    g = store.groupBy("model_type").agg(F.count(F.lit(1)).alias("total_patterns"), F.sum("frequency").alias("total_frequency"),
                                        F.sum(F.col("frequency") * F.col("severity")).alias("_fs"))
    prof = (g.join(_top(store, "hallucination_type"), "model_type").join(_top(store, "domain"), "model_type"))
    return (models.join(prof, "model_type", "left")
            .select("model_type", F.coalesce("total_patterns", F.lit(0)).cast("long").alias("total_patterns"),
                    F.coalesce("total_frequency", F.lit(0)).cast("long").alias("total_frequency"),
                    r6(safe_div("_fs", "total_frequency")).alias("vulnerability_score"),
                    F.col("top_hallucination_type").alias("most_common_type"),
                    F.col("top_domain").alias("most_vulnerable_domain")))


def compare_models(profile: DataFrame) -> DataFrame:
    """Relative vulnerability = score / max score (0 if max is 0).  The
    profile has one row per model (bounded), so the global max is cheap."""
    mx = F.max("vulnerability_score").over(Window.partitionBy())
    return profile.select("model_type", "vulnerability_score",
                          r6(F.when(mx > 0, F.col("vulnerability_score") / mx).otherwise(0.0)).alias("relative_vulnerability"))


def similar_patterns(store: DataFrame, probe: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Patterns with 0.4*[same type] + 0.3*[same domain] +
    0.3*(1-|severity diff|) >= threshold, excluding the probe itself.
    Three equi-joins find all matches: same type; same domain; and, for a
    threshold that severity alone can reach, severities within the allowed
    distance, by range bins of that width and their neighbours."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    p = (probe.select(F.col("pattern_id").alias("probe_id"), F.col("hallucination_type").alias("p_type"),
                                 F.col("domain").alias("p_domain"), F.col("severity").alias("p_sev")))
    sim = (F.when(F.col("hallucination_type") == F.col("p_type"), 0.4).otherwise(0.0)
           + F.when(F.col("domain") == F.col("p_domain"), 0.3).otherwise(0.0)
           + 0.3 * (1 - F.abs(F.col("severity") - F.col("p_sev"))))
    j = store.join(p, F.col("hallucination_type") == F.col("p_type")).unionByName(
        store.join(p, F.col("domain") == F.col("p_domain")).filter(~F.col("hallucination_type").eqNullSafe(F.col("p_type"))))
    if threshold <= 0.3:
        width = max(1 - threshold / 0.3, 1e-9)
        bins = lambda c: F.floor(F.col(c) / width)
        near = p.withColumn("_bin", F.explode(F.array(bins("p_sev") - 1, bins("p_sev"), bins("p_sev") + 1)))
        j = j.unionByName(store.withColumn("_bin", bins("severity")).join(near, "_bin").drop("_bin").filter(
            ~F.col("hallucination_type").eqNullSafe(F.col("p_type")) & ~F.col("domain").eqNullSafe(F.col("p_domain"))))
    return (j.withColumn("similarity", sim).filter((F.col("similarity") >= threshold - 1e-12) & (F.col("pattern_id") != F.col("probe_id")))
            .select("probe_id", "pattern_id", r6("similarity").alias("similarity")))


def filter_patterns(store: DataFrame, model_type=None, domain=None, hallucination_type=None) -> DataFrame:
    """Patterns of a model / domain / type."""
    out = store
    for col, v in (("model_type", model_type), ("domain", domain), ("hallucination_type", hallucination_type)):
        if v is not None:
            out = out.filter(F.col(col) == F.lit(v))
    return out


def store_summary(store: DataFrame) -> DataFrame:
    """P10: totals and the distinct models / types / domains."""
    return store.agg(F.count(F.lit(1)).alias("total_patterns"), F.countDistinct("model_type").alias("total_models"),
                     F.array_join(F.array_sort(F.collect_set("model_type")), ",").alias("models"),
                     F.array_join(F.array_sort(F.collect_set("hallucination_type")), ",").alias("hallucination_types"),
                     F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
