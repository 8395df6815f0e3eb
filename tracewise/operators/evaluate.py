"""Evaluation metrics (D1–D13) on score tables.

Scores: (group..., label 0/1, score in [0, 1]).  Every metric is a
partial-aggregating ``groupBy``.  AUROC / AUPRC need, per distinct score,
the counts below it; these prefix sums are computed exactly but without a
global sort: distinct scores are range-bucketed (4096 buckets of [0, 1]),
bucket totals are prefix-summed on the small bucket table, and only the
distinct scores of one bucket are ordered in one task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, r6, safe_div

RANGES = 256


def confusion(df: DataFrame, keys: list[str], label: str = "y", score: str = "score",
              threshold: float = 0.5) -> DataFrame:
    """tp/fp/tn/fn with prediction = score > threshold (strict, as the reference)."""
    pred = F.col(score) > F.lit(threshold)
    pos = F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.sum((pred & pos).cast("long")).alias("tp"), F.sum((pred & ~pos).cast("long")).alias("fp"),
        F.sum((~pred & ~pos).cast("long")).alias("tn"), F.sum((~pred & pos).cast("long")).alias("fn"))


def binary_metrics(df: DataFrame, keys: list[str], label: str = "y", score: str = "score",
                   threshold: float = 0.5) -> DataFrame:
    """D1 + D2: accuracy, precision, recall, F1 (0 on zero division), the
    confusion counts, and specificity / NPV (null unless both classes occur)."""
    c = confusion(df, keys, label, score, threshold)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    return c.select(
        *keys, "tp", "fp", "tn", "fn",
        r6(safe_div(tp + tn, tp + fp + tn + fn)).alias("accuracy"),
        r6(p).alias("precision"), r6(r).alias("recall"),
        r6(safe_div(2 * p * r, p + r)).alias("f1"),
        F.when(both, r6(safe_div(tn, tn + fp))).alias("specificity"),
        F.when(both, r6(safe_div(tn, tn + fn))).alias("npv"))


def metrics_at_thresholds(df: DataFrame, thresholds: dict[str, float], key: str = "domain", label: str = "y",
                          score: str = "score", default: float = 0.5) -> DataFrame:
    """``binary_metrics`` per ``key`` with each key's own threshold."""
    own = F.lit(default)
    for k, t in thresholds.items():
        own = F.when(F.col(key) == k, t).otherwise(own)
    pred = df.select(key, label, F.when(F.col(score) > own, 1.0).otherwise(0.0).alias("_p"))
    return binary_metrics(pred, [key], label, "_p")


def per_class_metrics(df: DataFrame, keys: list[str], label: str = "y", score: str = "score",
                      threshold: float = 0.5) -> DataFrame:
    """Precision / recall / F1 / support for class 1 and class 0."""
    c = confusion(df, keys, label, score, threshold)
    rows = []
    for cls, (tp, fp, fn) in ((1, ("tp", "fp", "fn")), (0, ("tn", "fn", "fp"))):
        p = safe_div(F.col(tp), F.col(tp) + F.col(fp))
        r = safe_div(F.col(tp), F.col(tp) + F.col(fn))
        rows.append(F.struct(F.lit(cls).cast("long").alias("cls"), r6(p).alias("precision"), r6(r).alias("recall"),
                             r6(safe_div(2 * p * r, p + r)).alias("f1"),
                             (F.col(tp) + F.col(fn)).cast("long").alias("support")))
    return c.select(*keys, F.inline(F.array(*rows)))


def _score_prefix(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per (keys, distinct score): pos, neg at that score and neg_below /
    pos_below = counts at strictly smaller scores, plus group totals."""
    d = df.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"),
                                      F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    # ranges of the scores as they lie (at most RANGES - 1 cuts), so skewed scores or scores outside [0, 1] still spread
    cuts = d.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)], 4 * RANGES)).first()[0] or []
    # a binary search over the cuts
    splits = [-float("inf"), *sorted(set(map(float, cuts))), float("inf")]
    d = Bucketizer(splits=splits, inputCol="_s", outputCol="_b", handleInvalid="keep").transform(d.withColumn("_s", F.col(score).cast("double"))).drop("_s")
    bt = d.groupBy(*keys, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*keys)
    bt = bt.select(*keys, "_b", (F.sum("_bp").over(wb) - F.col("_bp")).alias("_op"),
                   (F.sum("_bn").over(wb) - F.col("_bn")).alias("_on"),
                   F.sum("_bp").over(wall).alias("P"), F.sum("_bn").over(wall).alias("N"))
    wl = Window.partitionBy(*keys, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select(*keys, "_b", score, "pos", "neg",
                 (F.sum("pos").over(wl) - F.col("pos")).alias("_lp"), (F.sum("neg").over(wl) - F.col("neg")).alias("_ln"))
    cond = [d[k].eqNullSafe(bt[k]) for k in keys] + [d["_b"] == bt["_b"]]
    j = d.join(bt, cond).select(*[d[k] for k in keys], d[score], "pos", "neg",
                                (F.col("_op") + F.col("_lp")).alias("pos_below"),
                                (F.col("_on") + F.col("_ln")).alias("neg_below"), "P", "N")
    return j


def auroc(df: DataFrame, keys: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """D3: Mann–Whitney AUROC with ties counted half; 0 if one class is absent."""
    j = _score_prefix(df, keys, label, score)
    a = j.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
                             F.first("P").alias("P"), F.first("N").alias("N"))
    return a.select(*keys, r6(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))
                              .otherwise(0.0)).alias("auroc"))


def auprc(df: DataFrame, keys: list[str], label: str = "y", score: str = "score") -> DataFrame:
    """Average precision = sum over distinct thresholds (descending) of
    (R_n - R_{n-1}) * P_n; 0 when there are no positives."""
    j = _score_prefix(df, keys, label, score)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    a = j.groupBy(*keys).agg(F.sum(F.col("pos") * safe_div(tp, tp + fp)).alias("s"), F.first("P").alias("P"))
    return a.select(*keys, r6(safe_div("s", "P")).alias("auprc"))


def cross_domain_matrix(preds: DataFrame, home: DataFrame) -> DataFrame:
    """F1 per (trained_on, test_domain) with the in-domain flag.

    preds: (trained_on, test_domain, y, score); home: (trained_on, home_domain) – small, broadcast."""
    m = binary_metrics(preds, ["trained_on", "test_domain"], "y", "score")
    return (m.join(broadcast_if_small(home), "trained_on", "left")
            .select("trained_on", "test_domain", "f1", "accuracy",
                    (F.col("test_domain") == F.col("home_domain")).alias("in_domain")))


def ensemble_weighted(ms: DataFrame) -> DataFrame:
    """Per step, sum(p*w)/max(sum(w), 1e-8) for both heads, w = mean
    confidence (|p-.5|*2 + |q-.5|*2)/2.  ms: (chain_id, idx, model_type, node_prob, origin_prob)."""
    w = (F.abs(F.col("node_prob") - 0.5) * 2 + F.abs(F.col("origin_prob") - 0.5) * 2) / 2
    g = ms.withColumn("_w", w).groupBy("chain_id", "idx").agg(
        F.sum(F.col("node_prob") * F.col("_w")).alias("sn"), F.sum(F.col("origin_prob") * F.col("_w")).alias("so"),
        F.sum("_w").alias("sw"))
    tw = F.greatest(F.col("sw"), F.lit(1e-8))
    return g.select("chain_id", "idx", r6(F.col("sn") / tw).alias("node_pred"), r6(F.col("so") / tw).alias("origin_pred"))


def ensemble_max_confidence(ms: DataFrame) -> DataFrame:
    """Predictions of the most confident model; ties -> first model in
    input order (``model_order`` column, else model name)."""
    conf = (F.abs(F.col("node_prob") - 0.5) + F.abs(F.col("origin_prob") - 0.5)) / 2
    order = F.col("model_order") if "model_order" in ms.columns else F.col("model_type")
    g = ms.groupBy("chain_id", "idx").agg(
        F.min(F.struct((-conf).alias("c"), order.alias("o"), "node_prob", "origin_prob", "model_type")).alias("b"))
    return g.select("chain_id", "idx", r6("b.node_prob").alias("node_pred"), r6("b.origin_prob").alias("origin_pred"),
                    F.col("b.model_type").alias("selected_model"))


def ensemble_mean(ms: DataFrame) -> DataFrame:
    """Simple average of both heads."""
    return ms.groupBy("chain_id", "idx").agg(r6(F.avg("node_prob")).alias("node_pred"),
                                             r6(F.avg("origin_prob")).alias("origin_pred"))


def ensemble_routed(ms: DataFrame, steps_domain: DataFrame, routes: DataFrame) -> DataFrame:
    """D10 routing: use the model named for the chain's domain.
    steps_domain: (chain_id, domain); routes: (domain, model_type) – broadcast."""
    pick = steps_domain.join(broadcast_if_small(routes), "domain")
    return (ms.join(pick, ["chain_id", "model_type"])
            .select("chain_id", "idx", r6("node_prob").alias("node_pred"), r6("origin_prob").alias("origin_pred")))


def origin_recall(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of the origin head restricted to true origins."""
    return (scores.filter(F.col("y_origin") == 1).groupBy(*keys)
            .agg(r6(F.avg((F.col("origin_prob") > 0.5).cast("double"))).alias("origin_recall"),
                 F.count(F.lit(1)).alias("n_origins")))


def loss_columns(scores: DataFrame, keys: list[str], p: str = "node_prob", y: str = "y",
                 alpha: float = 0.25, gamma: float = 2.0, alpha2: float = 0.75, gamma2: float = 3.0,
                 pos_weight: float = 2.0) -> DataFrame:
    """Mean BCE, focal loss alpha(1-pt)^gamma*BCE with pt = exp(-BCE), and
    the improved focal loss with alpha_t and pos_weight.  p is clamped to
    [1e-7, 1-1e-7] so log(0) cannot occur."""
    pc = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    yy = F.col(y).cast("double")
    bce = -(yy * F.log(pc) + (1 - yy) * F.log(1 - pc))
    pt = F.exp(-bce)
    focal = F.lit(alpha) * F.pow(1 - pt, gamma) * bce
    at = F.lit(alpha2) * yy + (1 - F.lit(alpha2)) * (1 - yy)
    imp = at * F.pow(1 - pt, gamma2) * bce * (F.lit(pos_weight) * yy + (1 - yy))
    return scores.groupBy(*keys).agg(r6(F.avg(bce)).alias("bce"), r6(F.avg(focal)).alias("focal"),
                                     r6(F.avg(imp)).alias("improved_focal"))


def perturbation_report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Clean vs perturbed predictions against targets.
    pairs: (keys..., y, clean_score, pert_score, l2)."""
    cp = (F.col("clean_score") > 0.5).cast("int")
    rp = (F.col("pert_score") > 0.5).cast("int")
    ok = cp == F.col("y")
    g = pairs.groupBy(*keys).agg(
        F.avg((cp == F.col("y")).cast("double")).alias("acc_clean"), F.avg((rp == F.col("y")).cast("double")).alias("acc_robust"),
        F.avg("l2").alias("avg_perturbation"), F.sum(ok.cast("long")).alias("correct_clean"),
        F.sum((ok & (rp != F.col("y"))).cast("long")).alias("flipped"))
    return g.select(*keys, r6("acc_clean").alias("acc_clean"), r6("acc_robust").alias("acc_robust"),
                    r6(F.col("acc_clean") - F.col("acc_robust")).alias("acc_drop"), r6("avg_perturbation").alias("avg_perturbation"),
                    r6(safe_div("flipped", "correct_clean")).alias("attack_success_rate"))
