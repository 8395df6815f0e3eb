"""Rule-based labels and lookups (L1–L4).

All rules are fixed dimension tables or literal keyword lists; matching is a
built-in ``contains`` / ``rlike`` per row, or a join against a broadcast
rule table of a handful of rows (L3), so cost is linear in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Explanation texts and threshold of the reference.
SAFE_THRESHOLD = 0.6
SAFE_REASON = "This query complies with safety guidelines."
UNSAFE_REASON = "This query was flagged as potentially harmful."
# Allow-rule phrases, grouped as in the reference.
ALLOW_PHRASES = ["memory retrieval", "general chat", "communication", "greeting", "identity", "role",
                 "self-perception", "storing", "recall", "allergy"]
# Step status keywords.
SAFE_WORDS = ["safe", "verified"]
RISK_WORDS = ["risk", "error", "hallucination"]
# Context rules (order, keyword, context), first match wins.
CONTEXT_RULES = [
    (0, "sqrt", "CONTEXT FROM KNOWLEDGE BASE: The square root of a negative real number is not defined in the set of "
                "real numbers. However, in the complex number system, the square root of -1 (√-1) is defined as the "
                "imaginary unit 'i'. Therefore, √-16 = √16 * √-1 = 4i."),
    (0, "-16", "CONTEXT FROM KNOWLEDGE BASE: The square root of a negative real number is not defined in the set of "
               "real numbers. However, in the complex number system, the square root of -1 (√-1) is defined as the "
               "imaginary unit 'i'. Therefore, √-16 = √16 * √-1 = 4i."),
    (1, "delete", "CONTEXT FROM KNOWLEDGE BASE: Operations involving file deletion in system directories (like /tmp, "
                  "/etc) are strictly prohibited for safety reasons. The standard procedure is to modify files, not "
                  "delete them."),
]


def _pct2(x) -> F.Column:
    """'{:.2%}' of x (half-up on x*10000)."""
    c = F.floor(x * 10000 + 0.5).cast("long")
    return F.concat((c / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"), F.lit("%"))


def safety_explanation(df: DataFrame, prob: str) -> DataFrame:
    """L1: SAFE when p > 0.6; confidence |p - 0.5| * 2 as a percentage with
    two decimals; fixed reason text."""
    safe = F.col(prob) > SAFE_THRESHOLD
    return df.withColumn("status", F.when(safe, "SAFE").otherwise("UNSAFE")) \
        .withColumn("confidence", _pct2(F.abs(F.col(prob) - 0.5) * 2)) \
        .withColumn("reason", F.when(safe, SAFE_REASON).otherwise(UNSAFE_REASON))


def allow_rule(steps: DataFrame, key: str = "chain_id") -> DataFrame:
    """L2: chains where any step contains one of the allow phrases
    (case-insensitive) – one partial-aggregating group-by."""
    low = F.lower(F.col("text"))
    hit = F.lit(False)
    for p in ALLOW_PHRASES:
        hit = hit | low.contains(p)
    return steps.groupBy(key).agg(F.max(hit.cast("int")).cast("boolean").alias("allowed"))


def step_status(steps: DataFrame) -> DataFrame:
    """L4: safe / risk / neutral from keywords in the lower-cased text."""
    low = F.lower(F.col("text"))
    is_safe = F.lit(False)
    for w in SAFE_WORDS:
        is_safe = is_safe | low.contains(w)
    is_risk = F.lit(False)
    for w in RISK_WORDS:
        is_risk = is_risk | low.contains(w)
    return steps.withColumn("status", F.when(is_safe, "safe").when(is_risk, "risk").otherwise("neutral"))


def context_lookup(queries: DataFrame, rules: list[tuple[int, str, str]], text: str = "query") -> DataFrame:
    """L3: the context of the first rule (by order) whose keyword occurs in
    the query, else ''.  The rules are a list written in code, so the lookup
    is a projection: no join and no shuffle."""
    tests = [F.when(F.col(text).contains(keyword), context) for _, keyword, context in sorted(rules, key=lambda r: (r[0], r[1]))]
    return queries.withColumn("context", F.coalesce(*tests, F.lit("")))
