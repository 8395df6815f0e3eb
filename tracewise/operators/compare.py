"""Cross-model analysis.

Input is the long ``steps`` table (chain_id, idx, domain, model_type,
is_correct, error_type, ...).  All operators are partial-aggregating
``groupBy`` jobs; pairwise outputs (X4, X7) are built on the already
aggregated per-model / per-domain tables, whose size is bounded by the number
of models / domains, never by the number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import r6, safe_div


def _wrong():
    return F.when(F.col("is_correct"), 0).otherwise(1)


def error_rate_by_model(steps: DataFrame) -> DataFrame:
    """Wrong steps / all steps per model (0 if no steps)."""
    return (steps.groupBy("model_type")
            .agg(F.count(F.lit(1)).alias("total_steps"), F.sum(_wrong()).cast("long").alias("wrong_steps"))
            .select("model_type", "total_steps", "wrong_steps",
                    safe_div("wrong_steps", "total_steps").alias("error_rate")))


def accuracy_by_model_domain(steps: DataFrame) -> DataFrame:
    """Accuracy and total steps per (model, domain)."""
    return (steps.groupBy("model_type", "domain")
            .agg(F.count(F.lit(1)).alias("total_steps"),
                 F.sum(F.col("is_correct").cast("int")).cast("long").alias("correct_steps"))
            .select("model_type", "domain", "total_steps", "correct_steps",
                    safe_div("correct_steps", "total_steps").alias("accuracy")))


def rank_ascending(df: DataFrame, metric: str, key: str, name: str = "rnk") -> DataFrame:
    """1-based rank by ascending ``metric``; ties keep ``key`` order.

    ``df`` is an aggregate with one row per model (bounded), so the global
    window runs on a handful of rows.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.col(metric).asc(), F.col(key).asc())).cast("long"))


def error_rate_by_model_domain(steps: DataFrame) -> DataFrame:
    """Flagship: X1 + X2 + X5 – accuracy per model x domain with the model's
    overall error rate and its rank (1 = lowest error rate)."""
    per_md = accuracy_by_model_domain(steps)
    per_m = (per_md.groupBy("model_type")
             .agg(F.sum("total_steps").alias("m_total"), F.sum("correct_steps").alias("m_correct"))
             .select("model_type", (1 - safe_div("m_correct", "m_total")).alias("error_rate"),
                     "m_total"))
    per_m = per_m.withColumn("error_rate", F.when(F.col("m_total") > 0, F.col("error_rate")).otherwise(0.0))
    ranked = rank_ascending(per_m, "error_rate", "model_type")
    return (per_md.join(ranked, "model_type")
            .select("model_type", "domain", "total_steps", r6("accuracy").alias("accuracy"),
                    r6("error_rate").alias("error_rate"), "rnk"))


def error_type_mix(steps: DataFrame) -> DataFrame:
    """Wrong steps that carry an error type; count and % within model."""
    typed = steps.filter((~F.col("is_correct")) & F.col("error_type").isNotNull())
    c = typed.groupBy("model_type", "error_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model_type")
    return c.select("model_type", "error_type", "n",
                    r6(safe_div(F.col("n") * 100.0, F.sum("n").over(w))).alias("pct"))


def _pairs(keys: DataFrame, key: str) -> DataFrame:
    """All unordered pairs (a < b) of the distinct values in a small, already
    aggregated key table.  Built as an equi-join on a generated rank so no
    nested-loop join is planned; output size is the pair count itself."""
    k = keys.select(key).distinct()
    ranked = k.select(key, F.row_number().over(Window.orderBy(key)).alias("_r"),
                      F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    left = (ranked.filter(F.col("_r") < F.col("_n"))
            .select(F.col(key).alias(f"{key}_a"), F.explode(F.sequence(F.col("_r") + 1, F.col("_n"))).alias("_r2")))
    right = ranked.select(F.col(key).alias(f"{key}_b"), F.col("_r").alias("_r2"))
    return left.join(right, "_r2").select(f"{key}_a", f"{key}_b")


def model_similarity(steps: DataFrame) -> DataFrame:
    """Mean over the union of both models' domains of 1 - |acc_a - acc_b|,
    a domain absent for one model counting as accuracy 0."""
    acc = accuracy_by_model_domain(steps).select("model_type", "domain", "accuracy")
    pairs = _pairs(acc, "model_type")
    a = acc.select(F.col("model_type").alias("model_type_a"), "domain", F.col("accuracy").alias("acc_a"))
    b = acc.select(F.col("model_type").alias("model_type_b"), "domain", F.col("accuracy").alias("acc_b"))
    # domains of either side for every pair: (pair x domains of a) union (pair x domains of b)
    da = pairs.join(a, "model_type_a").select("model_type_a", "model_type_b", "domain")
    db = pairs.join(b, "model_type_b").select("model_type_a", "model_type_b", "domain")
    dom = da.unionByName(db).distinct()
    full = (dom.join(a, ["model_type_a", "domain"], "left").join(b, ["model_type_b", "domain"], "left")
            .select("model_type_a", "model_type_b",
                    (1 - F.abs(F.coalesce("acc_a", F.lit(0.0)) - F.coalesce("acc_b", F.lit(0.0)))).alias("s")))
    return (full.groupBy("model_type_a", "model_type_b").agg(r6(F.avg("s")).alias("similarity"))
            .select(F.col("model_type_a").alias("model_a"), F.col("model_type_b").alias("model_b"), "similarity"))


def signature_distance(metrics: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Pairwise Euclidean distance between per-``key`` metric vectors."""
    pairs = _pairs(metrics, key)
    a = metrics.select(F.col(key).alias(f"{key}_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = metrics.select(F.col(key).alias(f"{key}_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    j = pairs.join(a, f"{key}_a").join(b, f"{key}_b")
    d = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in cols))
    return j.select(f"{key}_a", f"{key}_b", r6(d).alias("distance"))


def transfer_gap(matrix: DataFrame) -> DataFrame:
    """In-domain F1 minus mean cross-domain F1 per trained_on (F1 in %);
    < 10 good, < 20 moderate, else specific.

    ``matrix`` has (trained_on, f1 in [0, 1], in_domain boolean).
    """
    g = (matrix.groupBy("trained_on")
         .agg(F.max(F.when(F.col("in_domain"), F.col("f1") * 100)).alias("in_domain"),
              F.avg(F.when(~F.col("in_domain"), F.col("f1") * 100)).alias("cross_domain")))
    gap = F.coalesce(F.col("in_domain"), F.lit(0.0)) - F.coalesce(F.col("cross_domain"), F.lit(0.0))
    return g.select("trained_on", r6(F.coalesce("in_domain", F.lit(0.0))).alias("in_domain_f1"),
                    r6(F.coalesce("cross_domain", F.lit(0.0))).alias("cross_domain_f1"),
                    r6(gap).alias("gap"),
                    F.when(gap < 10, "good").when(gap < 20, "moderate").otherwise("specific").alias("transfer"))


def comparative_report(steps: DataFrame) -> DataFrame:
    """One long table (section, key, value) assembling X1 error rates, X2
    accuracies, X3 error-type mix, X4 similarities, X5 rankings (lowest error rate
    first, highest vulnerability first), P7 vulnerability scores and the totals
    (chains, models)."""
    from tracewise.operators import patterns
    x1 = error_rate_by_model(steps).select(F.lit("error_rate").alias("section"), F.col("model_type").alias("key"),
                                           r6("error_rate").alias("value"))
    x2 = accuracy_by_model_domain(steps).select(F.lit("accuracy").alias("section"),
                                                F.concat_ws("|", "model_type", "domain").alias("key"), r6("accuracy").alias("value"))
    x5 = rank_ascending(error_rate_by_model(steps), "error_rate", "model_type").select(
        F.lit("ranking").alias("section"), F.col("model_type").alias("key"), F.col("rnk").cast("double").alias("value"))
    x4 = model_similarity(steps).select(F.lit("similarity").alias("section"), F.concat_ws("|", "model_a", "model_b").alias("key"),
                                        F.col("similarity").alias("value"))
    tot = steps.agg(F.countDistinct("chain_id").alias("c"), F.countDistinct("model_type").alias("m")).select(
        F.inline(F.array(F.struct(F.lit("totals").alias("section"), F.lit("total_chains").alias("key"),
                                  F.col("c").cast("double").alias("value")),
                         F.struct(F.lit("totals").alias("section"), F.lit("models").alias("key"),
                                  F.col("m").cast("double").alias("value")))))
    x3 = error_type_mix(steps).select(F.lit("error_mix").alias("section"), F.concat_ws("|", "model_type", "error_type").alias("key"),
                                      F.col("pct").alias("value"))
    store = patterns.pattern_store(patterns.extract_occurrences(steps))
    prof = patterns.vulnerability_profile(store, steps.select("model_type").distinct())
    weak = prof.select(F.lit("vulnerability").alias("section"), F.col("model_type").alias("key"), F.col("vulnerability_score").alias("value"))
    order = rank_ascending(prof.withColumn("_m", -F.col("vulnerability_score")), "_m", "model_type").select(
        F.lit("vulnerability_ranking").alias("section"), F.col("model_type").alias("key"), F.col("rnk").cast("double").alias("value"))
    out = x1
    for part in (x2, x3, x5, x4, weak, order, tot):
        out = out.unionByName(part)
    return out
