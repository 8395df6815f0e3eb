"""Text fingerprints of reasoning chains.

The reference computes every feature on the chain text joined with single
spaces.  Here nothing is concatenated: each feature is rewritten as a sum of
per-step quantities plus exact corrections for the joins, so the work is a
per-step projection followed by partial-aggregating ``groupBy(chain_id)``:

* words never span a join (the join is whitespace), so word counts, lengths
  and distinct words are per-step / per-(chain, word) aggregates;
* substring markers without a space cannot span a join; markers ending in a
  space ("i ", "is ", ...) match across it exactly when a step (other than
  the last) ends with the marker's letters;
* sentence pieces (``re.split('[.!?]+')``, kept when non-blank) merge across
  steps; a running count of delimiter-bearing steps gives each merged piece
  a group id, and a piece counts when any of its parts is non-blank.

All string work uses built-in functions (JVM side, whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import PY_NON_WS, PY_WS, r6, safe_div, strip_ws, substr_count, words

# Fixed values (reference word lists, in the reference's order).
HEDGE_WORDS = ["maybe", "perhaps", "possibly", "likely", "probably", "might", "could", "may", "seem",
               "appear", "suggest", "approximately", "roughly", "about", "around"]
CONFIDENCE_HIGH = ["definitely", "certainly", "clearly", "obviously", "undoubtedly"]
CONFIDENCE_LOW = ["uncertain", "unsure", "unclear", "ambiguous", "questionable"]
EXPLANATION_MARKERS = ["because", "therefore", "thus", "hence", "so", "since"]
FIRST_PERSON = ["i ", "we ", "i'", "we'", "my ", "our "]
PASSIVE_MARKERS = ["is ", "are ", "was ", "were ", "been ", "being "]
# Ordered 24-feature vector (total_words / total_sentences excluded).
FEATURE_NAMES = [
    "vocab_richness", "avg_word_length", "avg_words_per_sentence", "technical_density", "punctuation_density",
    "num_steps", "avg_step_length", "std_step_length", "avg_dependencies", "graph_depth", "branching_factor",
    "verbosity", "explanation_density", "question_density", "first_person_density", "passive_density",
    "hedge_density", "high_confidence_density", "low_confidence_density", "certainty_score",
    "numbered_ratio", "bullet_ratio", "code_density", "math_density",
]


def _count_all(col, markers) -> F.Column:
    return sum((substr_count(col, m) for m in markers), F.lit(0).cast("long"))


def _boundary(col, markers) -> F.Column:
    """Matches of space-terminated markers across the join after this step."""
    terms = [F.when(col.endswith(m[:-1]), 1).otherwise(0) for m in markers if m.endswith(" ")]
    return sum(terms, F.lit(0))


def concat_steps(steps: DataFrame) -> DataFrame:
    """the chain text, steps joined by one space in order.  Materialises
    one string per chain; the fingerprint below does not need it."""
    return steps.groupBy("chain_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("text"))


def step_measures(steps: DataFrame) -> DataFrame:
    """Per-step quantities every chain feature is summed from.  Texts are read
    before the shuffle: the window that tells the last step and the sentence
    group gets numbers and flags only."""
    w = Window.partitionBy("chain_id").orderBy("idx")
    deps = F.coalesce(F.size("depends_on"), F.lit(0)) if "depends_on" in steps.columns else F.when(F.col("idx") > 0, 1).otherwise(0)
    # columns of their own, so that each is computed once
    texts = steps.select("chain_id", "idx", "text", deps.alias("n_deps"), F.lower("text").alias("_low")).withColumns({
        "_words": words("_low"), "_pieces": F.split(F.col("text"), "[.!?]+", -1), "_stripped": strip_ws("text")})
    low, ws, pieces, stripped = (F.col(c) for c in ("_low", "_words", "_pieces", "_stripped"))
    m = F.size(pieces) - 1
    nonblank = (lambda p: p.rlike(PY_NON_WS))
    inner = F.when(m >= 2, F.size(F.filter(F.slice(pieces, 2, F.greatest(m - 1, F.lit(1))), nonblank))).otherwise(0)
    own = texts.select(
        "chain_id", "idx", "n_deps",
        F.size(ws).alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("sum_wlen"),
        F.size(F.filter(ws, lambda x: F.length(x) > 8)).alias("n_long"),
        F.length("text").alias("n_chars"),
        F.regexp_count(F.col("text"), F.lit("[,;:!?]")).alias("n_punct"),
        substr_count(F.col("text"), "?").alias("n_q"),
        _count_all(low, EXPLANATION_MARKERS).alias("n_expl"),
        _count_all(low, FIRST_PERSON).alias("_fp"), _boundary(low, FIRST_PERSON).alias("_fp_join"),
        _count_all(low, PASSIVE_MARKERS).alias("_pass"), _boundary(low, PASSIVE_MARKERS).alias("_pass_join"),
        _count_all(low, HEDGE_WORDS).alias("n_hedge"),
        _count_all(low, CONFIDENCE_HIGH).alias("n_high"),
        _count_all(low, CONFIDENCE_LOW).alias("n_low"),
        stripped.rlike(f"^\\p{{Nd}}+\\.?{PY_WS}").cast("int").alias("numbered"),
        stripped.rlike(f"^[-*•]{PY_WS}").cast("int").alias("bullet"),
        (substr_count(F.col("text"), "```") + substr_count(F.col("text"), "`")).alias("n_code"),
        (substr_count(F.col("text"), "$") + substr_count(F.col("text"), "=") + substr_count(F.col("text"), "+")
         + substr_count(F.col("text"), "*")).alias("n_math"),
        # sentence pieces
        m.alias("_m"), inner.alias("_inner"),
        nonblank(F.element_at(pieces, 1)).alias("_first"), nonblank(F.element_at(pieces, -1)).alias("_last"),
    )
    is_last = F.lead("idx").over(w).isNull()
    opened = F.sum(F.when(F.col("_m") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"_is_last": is_last, "_g": F.coalesce(opened, F.lit(0))})
    joined = lambda n, at_join: F.col(n) + F.when(F.col("_is_last"), 0).otherwise(F.col(at_join))
    return own.withColumns({"n_fp": joined("_fp", "_fp_join"), "n_pass": joined("_pass", "_pass_join")}).drop(
        "_fp", "_fp_join", "_pass", "_pass_join", "_is_last")


SUMMED = ["n_words", "sum_wlen", "n_long", "n_chars", "n_punct", "n_q", "n_expl", "n_fp", "n_pass", "n_hedge", "n_high", "n_low",
          "numbered", "bullet", "n_code", "n_math", "n_deps", "branching", "sq_words", "_inner"]


def fingerprint(steps: DataFrame) -> DataFrame:
    """All 26 features per chain (steps: chain_id, idx, text[, depends_on]).

    Two reads of the steps: one for the distinct words, one for all sums.  In the
    latter each step feeds its sentence group g (and, when it holds a delimiter, opens
    g + 1); its sums ride on the first of the two rows, so the groups and the
    chain's sums come from one partitioning on the chain."""
    # distinct words per chain (partial aggregation by (chain, word))
    uniq = (steps.select("chain_id", F.explode(F.array_distinct(words(F.lower("text")))).alias("w")).distinct()
            .groupBy("chain_id").agg(F.count(F.lit(1)).alias("unique_words")))
    sm = step_measures(steps).withColumns({"branching": (F.col("n_deps") > 1).cast("int"), "sq_words": F.col("n_words").cast("long") * F.col("n_words")})
    opens = F.struct(F.col("_g").alias("g"), F.col("_first").alias("ne"), F.lit(1).alias("own"))
    closes = F.struct((F.col("_g") + 1).alias("g"), F.col("_last").alias("ne"), F.lit(0).alias("own"))
    rows = sm.select("chain_id", *SUMMED, F.inline(F.when(F.col("_m") == 0, F.array(opens)).otherwise(F.array(opens, closes))))
    groups = rows.groupBy("chain_id", "g").agg(F.max(F.col("ne").cast("int")).alias("ne"), F.sum("own").alias("own"),
                                               *[F.sum(F.col(c) * F.col("own")).alias(c) for c in SUMMED])
    agg = groups.groupBy("chain_id").agg(F.sum("own").alias("num_steps"), F.sum("ne").alias("merged_sentences"), *[F.sum(c).alias(c) for c in SUMMED])
    n = F.col("num_steps")
    agg = agg.withColumns({
        "total_words": F.col("n_words"), "text_len": F.col("n_chars") + n - 1, "inner_sentences": F.col("_inner"),
        "avg_dependencies": F.col("n_deps") / n, "avg_step_length": F.col("n_words") / n,
        # exact in whole numbers: n * sum of squares - square of the sum
        "std_step_length": F.sqrt((n * F.col("sq_words") - F.col("n_words") * F.col("n_words")).cast("double")) / n})
    j = agg.join(uniq, "chain_id", "left")
    tw, n, tl = F.col("total_words"), F.col("num_steps"), F.col("text_len")
    sentences = F.col("inner_sentences") + F.coalesce("merged_sentences", F.lit(0))
    hedge, high, lowc = safe_div("n_hedge", tw), safe_div("n_high", tw), safe_div("n_low", tw)
    return j.select(
        "chain_id",
        r6(safe_div(F.coalesce("unique_words", F.lit(0)), tw)).alias("vocab_richness"),
        r6(safe_div("sum_wlen", tw)).alias("avg_word_length"),
        r6(safe_div(tw, sentences)).alias("avg_words_per_sentence"),
        r6(safe_div("n_long", tw)).alias("technical_density"),
        r6(safe_div("n_punct", tl)).alias("punctuation_density"),
        tw.cast("long").alias("total_words"), sentences.cast("long").alias("total_sentences"),
        n.cast("long").alias("num_steps"), r6("avg_step_length").alias("avg_step_length"),
        r6(F.coalesce("std_step_length", F.lit(0.0))).alias("std_step_length"),
        r6("avg_dependencies").alias("avg_dependencies"), n.cast("long").alias("graph_depth"),
        r6(safe_div("branching", n)).alias("branching_factor"),
        r6(safe_div(tw, n)).alias("verbosity"), r6(safe_div("n_expl", tl)).alias("explanation_density"),
        r6(safe_div("n_q", n)).alias("question_density"), r6(safe_div("n_fp", tw)).alias("first_person_density"),
        r6(safe_div("n_pass", tw)).alias("passive_density"),
        r6(hedge).alias("hedge_density"), r6(high).alias("high_confidence_density"), r6(lowc).alias("low_confidence_density"),
        r6(high - hedge - lowc).alias("certainty_score"),
        r6(safe_div("numbered", n)).alias("numbered_ratio"), r6(safe_div("bullet", n)).alias("bullet_ratio"),
        r6(safe_div("n_code", n)).alias("code_density"), r6(safe_div("n_math", n)).alias("math_density"),
    )


def feature_vector(fp: DataFrame) -> DataFrame:
    """the ordered 24-feature array (missing -> 0)."""
    return fp.select("chain_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_NAMES]).alias("features"))


def signature(fp: DataFrame) -> DataFrame:
    """propagation = round(0.5 + 0.4*certainty, 2); pattern Branching
    (branching > .1), else Exponential (technical > .3), else Linear."""
    return fp.select(
        "chain_id", F.round(0.5 + F.col("certainty_score") * 0.4, 2).alias("propagation"),
        F.col("graph_depth").alias("depth"),
        F.when(F.col("branching_factor") > 0.1, "Branching").when(F.col("technical_density") > 0.3, "Exponential")
         .otherwise("Linear").alias("pattern"),
        F.round("certainty_score", 2).alias("certainty"), F.round("vocab_richness", 2).alias("richness"))


def step_certainty(steps: DataFrame, chain_clean: DataFrame) -> DataFrame:
    """F16: per step clamp(1 - 5*hedge_density, 0.1, 0.99); the last step of
    a chain that is not clean is capped at 0.45.  chain_clean: (chain_id, clean)."""
    low = F.lower(F.col("text"))
    nw = F.size(words(low))
    hd = safe_div(_count_all(low, HEDGE_WORDS), nw)
    conf = F.least(F.lit(0.99), F.greatest(F.lit(0.1), 1.0 - hd * 5.0))
    last = F.lead("idx").over(Window.partitionBy("chain_id").orderBy("idx")).isNull()
    s = steps.withColumn("_is_last", last).join(chain_clean, "chain_id", "left")
    is_last = F.col("_is_last")
    capped = F.when(is_last & ~F.coalesce(F.col("clean"), F.lit(True)), F.least(conf, F.lit(0.45))).otherwise(conf)
    return s.select("chain_id", "idx", r6(capped).alias("certainty"))
