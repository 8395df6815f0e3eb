"""Proactive risk analytics, batch form.

Steps: (chain_id, idx, is_correct, risk) where ``risk`` = 1 - p_correct of the
step as scored.  Look-ahead and running quantities are window functions over
``partition by chain_id``; every frame used is a *running* frame (looking
ahead is written as a running frame over the reversed order), which Spark
evaluates incrementally without buffering the whole chain.

Replay semantics (R14) follow the reference: after each new step the whole
prefix is re-scored and every step at or above the warning threshold is
counted again.  Because step scores here do not depend on the prefix, the
replay collapses to a closed form: step j of an n-step chain is counted
(n - j) times, and the first prefix whose maximum risk reaches MEDIUM is the
first step with risk >= 0.3.  ``replay_expanded`` materialises the replay for
tests on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, r6, safe_div

# Predictor risk bands and controller defaults of the reference.
LOW_MAX = 0.3
MEDIUM_MAX = 0.7
WARN_THRESHOLD = 0.3
CORRECT_THRESHOLD = 0.7
# Rotating correction suggestions (reference wording, in order).
SUGGESTIONS = [
    "Double-check calculations and verify with the previous step",
    "Review the logical flow and ensure assumptions are valid",
    "Verify that all dependencies are correctly satisfied",
    "Consider alternative approaches to this reasoning step",
    "Cross-reference with domain knowledge and best practices",
]
# Proactive targets (metric, target, direction).
TARGETS = [("detection_rate", 0.8, ">="), ("false_positive_rate", 0.2, "<="), ("early_detection_rate", 0.7, ">=")]
# Threshold search grid of the reference.
WARN_GRID = [0.3, 0.4, 0.5, 0.6, 0.7]
CORRECT_GRID = [0.6, 0.7, 0.8, 0.9]


def band(score) -> F.Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < LOW_MAX, "LOW").when(s < MEDIUM_MAX, "MEDIUM").otherwise("HIGH")


def lookahead_labels(steps: DataFrame) -> DataFrame:
    """steps_until_error (1-based, -1 if none), future_error_count,
    is_vulnerable, risk_level per step of the full chain."""
    rev = (Window.partitionBy("chain_id").orderBy(F.col("idx").desc())
           .rowsBetween(Window.unboundedPreceding, -1))
    wrong = ~F.col("is_correct")
    nxt = F.min(F.when(wrong, F.col("idx"))).over(rev)
    cnt = F.count(F.when(wrong, F.lit(1))).over(rev)
    x = steps.select("chain_id", "idx", nxt.alias("_next"), cnt.alias("future_error_count"))
    until = F.coalesce(F.col("_next") - F.col("idx"), F.lit(-1)).cast("long")
    return x.select(
        "chain_id", "idx", until.alias("steps_until_error"), F.col("future_error_count").cast("long").alias("future_error_count"),
        (until > 0).alias("is_vulnerable"),
        F.when(until == -1, "LOW").when(until == 1, "HIGH").when(until <= 3, "MEDIUM").otherwise("LOW").alias("risk_level"))


def prefix_chains(steps: DataFrame, edges: DataFrame | None = None, min_len: int = 3, max_len: int | None = None,
                  include_correct: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """C12 + R2: every prefix of length k in [min_len, n] (at most ``max_len`` when given, 10 in the reference) of
    chains with at least ``min_len`` steps.  Each step is exploded into the
    prefixes that contain it, so no join is needed; the prefix id is
    (chain_id, k).  Edges are kept when both ends are < k."""
    w = Window.partitionBy("chain_id")
    s = steps.withColumn("_n", F.count(F.lit(1)).over(w))
    if not include_correct:
        s = s.withColumn("_e", F.max((~F.col("is_correct")).cast("int")).over(w)).filter(F.col("_e") == 1).drop("_e")
    s = s.filter(F.col("_n") >= min_len)
    hi = F.col("_n") if max_len is None else F.least(F.col("_n"), F.lit(max_len))
    lo = F.greatest(F.col("idx") + 1, F.lit(min_len))
    out = (s.filter(lo <= hi).withColumn("k", F.explode(F.sequence(lo.cast("long"), hi.cast("long")))).drop("_n"))
    pe = None
    if edges is not None:
        n = s.select("chain_id", "_n").distinct()
        e = edges.join(n, "chain_id")
        lo_e = F.greatest(F.greatest(F.col("src"), F.col("dst")) + 1, F.lit(min_len))
        hi_e = hi
        pe = e.filter(lo_e <= hi_e).withColumn("k", F.explode(F.sequence(lo_e.cast("long"), hi_e.cast("long")))).drop("_n")
    return out, pe


def prefix_samples(steps: DataFrame, min_len: int = 3, max_len: int | None = None, include_correct: bool = True) -> DataFrame:
    """R2: prefix steps with look-ahead labels computed on the *full* chain."""
    labels = lookahead_labels(steps)
    pref, _ = prefix_chains(steps, None, min_len, max_len, include_correct)
    return pref.join(labels, ["chain_id", "idx"])


def sample_stats(samples: DataFrame, split_of_chain: DataFrame) -> DataFrame:
    """Train / val sample counts; vulnerable / safe counted on train only.
    A sample (chain_id, k) is vulnerable when any of its labels is."""
    per = samples.groupBy("chain_id", "k").agg(F.max(F.col("is_vulnerable").cast("int")).alias("v"))
    j = per.join(split_of_chain, "chain_id")
    return j.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train_samples"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val_samples"),
        F.count(F.when((F.col("split") == "train") & (F.col("v") == 1), 1)).alias("vulnerable_samples"),
        F.count(F.when((F.col("split") == "train") & (F.col("v") == 0), 1)).alias("safe_samples"))


def risk_bands(steps: DataFrame) -> DataFrame:
    """Chain summary (max risk, its level, number of vulnerable steps);
    the vulnerable steps themselves are the rows of ``steps_at_level``."""
    s = steps.withColumn("is_vulnerable", F.col("risk") >= LOW_MAX)
    return s.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("num_steps"), r6(F.max("risk")).alias("overall_risk_score"),
        F.sum(F.col("is_vulnerable").cast("int")).cast("long").alias("n_vulnerable"),
    ).withColumn("overall_risk_level", band("overall_risk_score"))


def steps_at_level(steps: DataFrame, level: str) -> DataFrame:
    """Steps whose band is at or above ``level`` (LOW returns all)."""
    floor = {"LOW": 0.0, "MEDIUM": LOW_MAX, "HIGH": MEDIUM_MAX}[level]
    return steps.filter(F.col("risk") >= floor)


def running_risk(steps: DataFrame) -> DataFrame:
    """After each step, the prefix risk = max of its step risks."""
    w = Window.partitionBy("chain_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.max("risk").over(w)
    return steps.select("chain_id", "idx", r6("risk").alias("risk"), r6(m).alias("prefix_risk"), band(m).alias("prefix_level"))


def _cents(x) -> F.Column:
    """Two-decimal text of x (half-up on the double x*100)."""
    c = F.floor(x * 100 + 0.5).cast("long")
    return F.concat((c / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def interventions(steps: DataFrame, warn: float = WARN_THRESHOLD, correct: float = CORRECT_THRESHOLD,
                  enable_warnings: bool = True, enable_corrections: bool = True,
                  rule_based: bool = True) -> DataFrame:
    """R10 + R11: intervention decision and message text per step.

    risk >= correct (corrections on) -> CORRECTION; else risk >= warn
    (warnings on) -> WARNING; else no row.  The warning shows the risk with
    two decimals, rounded half-up (Python rounds the binary value half-even;
    the two differ only on exact binary ties)."""
    sid = F.col("step_id") if "step_id" in steps.columns else F.col("idx")
    risk = F.col("risk")
    is_corr = (risk >= correct) if enable_corrections else F.lit(False)
    is_warn = (risk >= warn) if enable_warnings else F.lit(False)
    kind = F.when(is_corr, "CORRECTION").when(is_warn, "WARNING")
    sugg = F.array(*[F.lit(s) for s in SUGGESTIONS])
    corr_text = (F.concat(F.lit("Step "), sid.cast("string"), F.lit(": "), F.element_at(sugg, (F.pmod(sid, F.lit(5)) + 1).cast("int")))
                 if rule_based else
                 F.concat(F.lit("HIGH RISK: Step "), sid.cast("string"), F.lit(" requires careful review and potential revision")))
    warn_text = F.concat(F.lit("CAUTION: Step "), sid.cast("string"), F.lit(" shows moderate vulnerability (risk: "),
                         _cents(risk), F.lit(")"))
    return (steps.withColumn("intervention_type", kind).filter(F.col("intervention_type").isNotNull())
            .select("chain_id", sid.alias("step_id"), "intervention_type", band("risk").alias("risk_level"),
                    r6("risk").alias("risk_score"),
                    F.when(F.col("intervention_type") == "WARNING", warn_text).alias("warning_message"),
                    F.when(F.col("intervention_type") == "CORRECTION", corr_text).alias("correction_suggestion")))


def intervention_history(iv: DataFrame, chain_id=None) -> DataFrame:
    """History, optionally for one chain."""
    return iv if chain_id is None else iv.filter(F.col("chain_id") == F.lit(chain_id))


def intervention_stats(iv: DataFrame) -> DataFrame:
    """Totals, warnings, corrections, MEDIUM/HIGH counts (LOW is fixed
    0 as in the reference), distinct chains."""
    return iv.agg(F.count(F.lit(1)).alias("total_interventions"),
                  F.count(F.when(F.col("intervention_type") == "WARNING", 1)).alias("warnings"),
                  F.count(F.when(F.col("intervention_type") == "CORRECTION", 1)).alias("corrections"),
                  F.lit(0).cast("long").alias("low_count"),
                  F.count(F.when(F.col("risk_level") == "MEDIUM", 1)).alias("medium_count"),
                  F.count(F.when(F.col("risk_level") == "HIGH", 1)).alias("high_count"),
                  F.countDistinct("chain_id").alias("unique_chains"))


def chain_replay(steps: DataFrame, warn_values: list[float] | None = None) -> DataFrame:
    """R14 (closed form) per chain: first error, first MEDIUM/HIGH prefix,
    and the replay intervention count for each warning threshold."""
    warn_values = warn_values or [WARN_THRESHOLD]
    # sum over flagged steps j of (n - j) = n * count - sum(j): one aggregate, no window
    aggs = [F.min(F.when(~F.col("is_correct"), F.col("idx"))).alias("first_error"),
            F.min(F.when(F.col("risk") >= LOW_MAX, F.col("idx"))).alias("first_flag"),
            F.count(F.lit(1)).alias("num_steps")]
    for i, t in enumerate(warn_values):
        aggs += [F.count(F.when(F.col("risk") >= t, 1)).alias(f"_c{i}"),
                 F.sum(F.when(F.col("risk") >= t, F.col("idx")).otherwise(0)).alias(f"_s{i}")]
    g = steps.groupBy("chain_id").agg(*aggs)
    for i in range(len(warn_values)):
        g = g.withColumn(f"iv_{i}", (F.col("num_steps") * F.col(f"_c{i}") - F.col(f"_s{i}")).cast("long"))
    has_err = F.col("first_error").isNotNull()
    detected = has_err & F.col("first_flag").isNotNull()
    early = detected & (F.col("first_flag") < F.col("first_error"))
    return g.select("chain_id", "num_steps", has_err.alias("has_error"), F.coalesce("first_error", F.lit(-1)).alias("first_error_step"),
                    detected.alias("vulnerability_detected"), early.alias("detected_early"),
                    F.when(early, F.col("first_error") - F.col("first_flag")).otherwise(-1).alias("steps_before_error"),
                    *[f"iv_{i}" for i in range(len(warn_values))])


def replay_expanded(steps: DataFrame, warn: float = WARN_THRESHOLD) -> DataFrame:
    """R14 literally: every prefix re-scores all its steps (quadratic; for
    tests on small inputs).  Returns (chain_id, interventions)."""
    p = steps.select("chain_id", F.col("idx").alias("k"))
    return (p.join(steps, "chain_id").filter(F.col("idx") <= F.col("k"))
            .groupBy("chain_id").agg(F.count(F.when(F.col("risk") >= warn, 1)).alias("interventions")))


def proactive_metrics(replay: DataFrame, iv_col: str = "iv_0", keys: list[str] | None = None) -> DataFrame:
    """Detection, early detection, FP, FN, FPR, average lead; 0 on empty
    denominators."""
    keys = keys or []
    a = replay.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chains"),
        F.count(F.when(F.col("has_error"), 1)).alias("chains_with_errors"),
        F.count(F.when(F.col("vulnerability_detected"), 1)).alias("vulnerability_detected"),
        F.count(F.when(F.col("detected_early"), 1)).alias("early_detections"),
        F.sum(iv_col).cast("long").alias("interventions_triggered"),
        F.count(F.when(~F.col("has_error") & (F.col(iv_col) > 0), 1)).alias("false_positives"),
        F.count(F.when(F.col("has_error") & ~F.col("vulnerability_detected"), 1)).alias("false_negatives"),
        F.avg(F.when(F.col("detected_early"), F.col("steps_before_error"))).alias("_lead"))
    correct = F.col("total_chains") - F.col("chains_with_errors")
    return a.select(*keys, "total_chains", "chains_with_errors", "vulnerability_detected", "early_detections",
                    "interventions_triggered", "false_positives", "false_negatives",
                    r6(safe_div("vulnerability_detected", "chains_with_errors")).alias("detection_rate"),
                    r6(safe_div("early_detections", "chains_with_errors")).alias("early_detection_rate"),
                    r6(F.coalesce("_lead", F.lit(0.0))).alias("avg_time_to_detection"),
                    r6(safe_div("false_positives", correct)).alias("false_positive_rate"))


def threshold_grid(steps: DataFrame, warn_grid: list[float] | None = None,
                   correct_grid: list[float] | None = None) -> DataFrame:
    """Metrics for every (warn, correct) grid pair with correct > warn.

    Interventions depend only on the warning threshold (a correction
    threshold above it re-labels, never adds), so the replay is aggregated
    once per distinct warn value with conditional sums and the grid is
    attached by an equi-join on warn – no per-step expansion by the grid.
    Ranks: ``rank_valid`` among DR >= .8 and FPR <= .2 by early detection
    desc; ``rank_tradeoff`` by (DR desc, FPR asc); ties keep grid order."""
    warns = list(warn_grid or WARN_GRID)
    corrects = list(correct_grid or CORRECT_GRID)
    spark_grid = steps.sparkSession.createDataFrame(
        [(w, c) for w in warns for c in corrects], "warn_threshold double, correct_threshold double")
    rep = chain_replay(steps, warns)
    per_warn = None
    for i, t in enumerate(warns):
        m = proactive_metrics(rep, f"iv_{i}").withColumn("warn_threshold", F.lit(t))
        per_warn = m if per_warn is None else per_warn.unionByName(m)
    g = spark_grid.filter(F.col("correct_threshold") > F.col("warn_threshold"))
    j = g.join(per_warn, "warn_threshold")
    valid = (F.col("detection_rate") >= 0.8) & (F.col("false_positive_rate") <= 0.2)
    order = [F.col("warn_threshold"), F.col("correct_threshold")]
    j = j.withColumn("valid", valid)
    j = j.withColumn("rank_valid", F.when(F.col("valid"), F.row_number().over(
        Window.partitionBy("valid").orderBy(F.col("early_detection_rate").desc(), *order))))
    j = j.withColumn("rank_tradeoff", F.row_number().over(
        Window.orderBy(F.col("detection_rate").desc(), F.col("false_positive_rate").asc(), *order)))
    return j.select("warn_threshold", "correct_threshold", "detection_rate", "false_positive_rate",
                    "early_detection_rate", "avg_time_to_detection", "interventions_triggered", "valid",
                    F.col("rank_valid").cast("long").alias("rank_valid"), F.col("rank_tradeoff").cast("long").alias("rank_tradeoff"))


def target_assessment(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Actual vs target per metric with direction.  ``metrics`` is the
    one-row R15 output; targets: (metric, target, direction)."""
    names = [r[0] for r in TARGETS]
    long = metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("actual"))
                                             for n in names])))
    j = long.join(broadcast_if_small(targets), "metric")
    passed = F.when(F.col("direction") == "<=", F.col("actual") <= F.col("target")).otherwise(F.col("actual") >= F.col("target"))
    return j.select("metric", "actual", "target", "direction", passed.alias("passed"))
