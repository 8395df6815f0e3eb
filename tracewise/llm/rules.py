"""Quality rules by weak supervision, in DataFrame functions only.

``text_statistics`` measures a text; ``rule_votes`` lets each rule vote good (1), bad (-1) or abstain (0);
``fit_rules`` estimates each rule's accuracy by expectation-maximisation, run until it stands still, over the table of
vote patterns (one aggregate of the documents, at most 3**rules rows however many they are; only these counts reach the driver), and ``posterior`` is the probability that a
document is good given its votes, each vote weighing as much as its rule proved accurate.

The model: a document is good with probability ``prior``; a rule that votes says the truth with its own
probability, fitted apart for good and for bad documents.  Rules start as specialists: they seldom call
a good document bad (GOOD_RIGHT), and a bad document trips only some of them (BAD_RIGHT).  A Beta prior worth
STRENGTH of the documents holds the accuracies near that start, so that a corpus without bad documents does
not invent some; a rule that never trips on bad documents ends with good votes that weigh nothing.

Nulls and empty texts: all counts 0, so ``base_failed``.  Repeated rows count as often as they stand.  An
empty table fits the priors and gives an empty result.  A long text is one row's array of words.  ``keep`` names what comes back
beside the result; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import let, materialise, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3
STRENGTH = 0.02
GOOD_RIGHT = 0.995
BAD_RIGHT = 0.2
PRIOR = 0.8
TOLERANCE = 1e-10  # EM has converged when no vote's log-odds moves by more in a round
RULES = ("symbols", "repeats", "dup_lines", "word_length", "shouting", "sentences", "loose_marks", "plain")


def _repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the array.

    Distinct window hashes show whether any window repeats; only then are (hash, place) pairs sorted,
    the places with an equal neighbour marked and the words that those windows cover counted.
    """
    n = F.size(words)

    def hashes(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)]))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(p):
            same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (same(k, k - 1) | same(k, k + 1)).alias("d"))),
                                                     lambda x: x["d"]), lambda x: x["i"]))

        # a window adds its words but those that the marked window before it covers
        count = lambda m: F.aggregate(
            m, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n")))["n"]
        return let(let(pairs, marked), count)

    def found(h):
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))

    return F.when(n >= WINDOW, let(hashes(words), found)).otherwise(F.lit(0).cast("long"))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' raw measures (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    measures = let(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _repeated_words(w).alias("n_repeat_words")))
    lean = F.octet_length(t)
    less = lambda chars: (lean - F.octet_length(F.translate(t, chars, ""))).cast("long")
    out = df.withColumns({"_m": measures, "n_symbols": less(SYMBOLS), "n_dup_lines": dup.cast("long"),
                          "n_upper": less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_lower": less("abcdefghijklmnopqrstuvwxyz"),
                          "n_stops": less(".?;:"), "n_marks": less("!|~^=+_{}[]\\")})
    return out.withColumns({c: F.col("_m")[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_m")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rule_votes() -> dict[str, Column]:
    """Each rule's vote on the statistics: 1 good, -1 bad, 0 abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    few = n < 5
    return {
        "symbols": vote(F.col("n_symbols") * 10 > n, (F.col("n_symbols") * 50 <= n) & ~few),
        "repeats": vote(F.col("n_repeat_words") * 10 > n * 4, (F.col("n_repeat_words") * 10 <= n * 2) & ~few),
        "dup_lines": vote(F.col("n_dup_lines") * 30 > n, (F.col("n_dup_lines") == 0) & (n >= 50)),
        "word_length": vote(((chars > n * 20) | (chars < n * 2)) & (n > 0), (chars <= n * 12) & (chars >= n * 3)),
        "shouting": vote((F.col("n_upper") > F.col("n_lower")) & ~few, (F.col("n_upper") * 5 <= F.col("n_lower")) & ~few),
        "sentences": vote((F.col("n_stops") * 200 < n) & (n >= 50), (F.col("n_stops") * 60 >= n) & ~few),
        "plain": vote(F.col("n_symbols") + F.col("n_marks") > chars * 0.08, (F.col("n_symbols") + F.col("n_marks") <= chars * 0.01) & ~few),
        "loose_marks": vote(F.col("n_marks") * 5 > n, (F.col("n_marks") * 50 <= n) & ~few),
    }


def fit_rules(patterns: DataFrame, rules: tuple[str, ...] = RULES) -> dict[str, float]:
    """EM over the vote patterns (the rules' columns and ``n``): the log-odds that each vote adds.

    A fit without documents is the start.
    """
    rows = sorted(tuple(r) for r in patterns.select("n", *rules).collect())
    return converged([r[1:] for r in rows], [r[0] for r in rows], rules)


def converged(votes: list[tuple[int, ...]], counts: list[int], rules: tuple[str, ...] = RULES) -> dict[str, float]:
    """The log-odds at which EM stands still, for these patterns of votes and how often each stands."""
    good = {r: GOOD_RIGHT for r in rules}  # P(vote good | votes, document good)
    bad = {r: BAD_RIGHT for r in rules}  # P(vote bad | votes, document bad)
    total = sum(counts)
    held = max(1.0, STRENGTH * total)
    share = lambda hit, miss, start: (hit + held * start) / (hit + miss + held)
    voters = {(r, v): [i for i, x in enumerate(votes) if x[k] == v] for k, r in enumerate(rules) for v in (1, -1)}
    weights = _weights(good, bad, PRIOR)
    moved = math.inf if votes else 0.0
    while moved > TOLERANCE:
        likely = []  # documents of each pattern that are held to be good
        for x, n in zip(votes, counts, strict=True):
            odds = weights["prior"] + sum(weights[f"{r}{'+' if v > 0 else '-'}"] for r, v in zip(rules, x, strict=True) if v)
            likely.append(n / (1 + math.exp(-odds)))
        sums = {k: (sum(likely[i] for i in of), sum(counts[i] - likely[i] for i in of)) for k, of in voters.items()}
        good = {r: share(sums[r, 1][0], sums[r, -1][0], GOOD_RIGHT) for r in rules}
        bad = {r: share(sums[r, -1][1], sums[r, 1][1], BAD_RIGHT) for r in rules}
        new = _weights(good, bad, (sum(likely) + held * PRIOR) / (total + held))
        moved = max(abs(new[k] - weights[k]) for k in new)
        weights = new
    return weights


def _weights(good: dict[str, float], bad: dict[str, float], prior: float) -> dict[str, float]:
    """Log-odds of a good document: of the prior, and of each rule's good and bad vote.

    A rule is held to be no worse than a coin, so no vote counts against what it says.
    """
    odds = {"prior": math.log(prior / (1 - prior))}
    for r in good:
        odds[f"{r}+"] = max(0.0, math.log(good[r] / (1 - bad[r])))
        odds[f"{r}-"] = min(0.0, math.log((1 - good[r]) / bad[r]))
    return odds


def posterior(weights: dict[str, float], rules: tuple[str, ...] = RULES) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(weights["prior"])
    for r in rules:
        odds = odds + F.when(F.col(r) == 1, weights[f"{r}+"]).when(F.col(r) == -1, weights[f"{r}-"]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the statistics, votes, ``base_failed``, ``quality`` (posterior) and ``kept`` of each row."""
    stats = text_statistics(docs.select(*keep, F.col(text).alias("_text")), "_text").drop("_text")
    stats = materialise(stats.withColumns(rule_votes()).withColumn("base_failed", base_failed()), "rules")
    patterns = stats.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n"))
    weights = fit_rules(materialise(patterns, "votes"))
    p = posterior(weights)
    return stats.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (p >= threshold))
