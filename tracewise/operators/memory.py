"""Conversation memory across turns.

Input: ``turn_steps`` (conv_id, turn, step_idx, text) and the list of turns
(conv_id, turn).  The reference checks each turn against everything added
from earlier turns and then adds it (check-then-add), so "earlier" means
turn < current turn and same-turn conflicts are never reported.

Contradictions are computed without a pairwise self-join.  For a key
(conversation + entity name, or + claim subject/predicate) only two earlier
mentions can ever be "the first earlier mention with a different value":
the key's very first mention f1, and the first mention f2 whose value
differs from f1's.  A current mention with value v at turn t conflicts with
f1 when v != v1 and f1 is earlier, else with f2 when f2 is earlier.  Both
are partial-aggregating ``min`` aggregates, joined back by key: linear work
even when one name is mentioned millions of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import PY_WS, WORD_RE, r6, safe_div
from tracewise.session import cut_lineage

# Fixed values (reference): words never treated as names, decay rate, windows.
NAME_STOP = ["The", "A", "An", "If", "Then"]
DECAY_RATE = 0.1
MAX_TURNS = 10
RECENT_TURNS = 3
ENTITY_WEIGHT = 0.8
CLAIM_WEIGHT = 1.0

NUMBER_RE = f"({WORD_RE}){PY_WS}*={PY_WS}*([0-9]+\\.?[0-9]*)"
CLAIM_RE = f"(?i)({WORD_RE}){PY_WS}+(?:is|equals){PY_WS}+({WORD_RE})"


def extract_entities(turn_steps: DataFrame) -> DataFrame:
    """H1 + H2: (conv_id, turn, step_idx, pos, name, kind, value_num,
    value_str, vkey).  Numbers come first within a step, then names, each in
    match order (the reference's insertion order).  ``vkey`` compares values
    the way Python does: float vs float, str vs str, mixed never equal."""
    # matches zipped with their position, then ``inline`` (no field access after a generator)
    nz = F.arrays_zip(F.regexp_extract_all("text", F.lit(NUMBER_RE), 1).alias("n"),
                      F.regexp_extract_all("text", F.lit(NUMBER_RE), 2).alias("v"))
    nums = turn_steps.select("conv_id", "turn", "step_idx",
                             F.inline(F.transform(nz, lambda z, i: F.struct(i.alias("m"), z["n"].alias("name"), z["v"].alias("v")))))
    nums = nums.select("conv_id", "turn", "step_idx", F.struct(F.lit(0).alias("k"), F.col("m").alias("m")).alias("pos"),
                       "name", F.lit("number").alias("kind"),
                       F.col("v").cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"))
    toks = turn_steps.select("conv_id", "turn", "step_idx",
                             F.posexplode(F.regexp_extract_all("text", F.lit(WORD_RE), 0)).alias("m", "tok"))
    names = (toks.filter(F.col("tok").rlike("^[A-Z][a-z]+$") & ~F.col("tok").isin(NAME_STOP))
             .select("conv_id", "turn", "step_idx", F.struct(F.lit(1).alias("k"), F.col("m").alias("m")).alias("pos"),
                     F.col("tok").alias("name"), F.lit("person").alias("kind"),
                     F.lit(None).cast("double").alias("value_num"), F.col("tok").alias("value_str")))
    ent = nums.unionByName(names)
    vkey = F.when(F.col("kind") == "number", F.concat(F.lit("n:"), F.col("value_num").cast("string"))) \
        .otherwise(F.concat(F.lit("s:"), F.col("value_str")))
    shown = F.when(F.col("kind") == "number", F.col("value_num").cast("string")).otherwise(F.col("value_str"))
    return ent.withColumn("vkey", vkey).withColumn("value", shown)


def extract_claims(turn_steps: DataFrame) -> DataFrame:
    """H3: (subject, 'is', object) per match, case kept."""
    cz = F.arrays_zip(F.regexp_extract_all("text", F.lit(CLAIM_RE), 1).alias("s"),
                      F.regexp_extract_all("text", F.lit(CLAIM_RE), 2).alias("o"))
    c = turn_steps.select("conv_id", "turn", "step_idx",
                          F.inline(F.transform(cz, lambda z, i: F.struct(i.alias("m"), z["s"].alias("subject"),
                                                                         z["o"].alias("object")))))
    return c.select("conv_id", "turn", "step_idx", F.struct(F.lit(0).alias("k"), F.col("m").alias("m")).alias("pos"),
                    "subject", F.lit("is").alias("predicate"), "object",
                    F.col("object").alias("value"), F.col("object").alias("vkey"))


def first_conflicts(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """H4 / H5 core: for every mention, the first mention of the same key
    in an earlier turn whose value differs (null when there is none).

    mentions: (*keys, turn, step_idx, pos, vkey, value)."""
    order = F.struct("turn", "step_idx", "pos")
    first = mentions.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "vkey", "value")).alias("f1"))
    m1 = mentions.join(first, keys)
    second = (m1.filter(F.col("vkey") != F.col("f1.vkey")).groupBy(*keys)
              .agg(F.min(F.struct(order.alias("o"), "vkey", "value")).alias("f2")))
    j = m1.join(second, keys, "left")
    use1 = (F.col("vkey") != F.col("f1.vkey")) & (F.col("f1.o.turn") < F.col("turn"))
    use2 = (F.col("vkey") == F.col("f1.vkey")) & F.col("f2").isNotNull() & (F.col("f2.o.turn") < F.col("turn"))
    prev = F.when(use1, F.col("f1")).when(use2, F.col("f2"))
    return j.withColumn("_prev", prev).drop("f1", "f2")


def entity_conflicts(entities: DataFrame) -> DataFrame:
    """H4: one row per current entity mention contradicting an earlier turn."""
    fc = first_conflicts(entities, ["conv_id", "name"])
    return fc.filter(F.col("_prev").isNotNull()).select(
        "conv_id", "turn", "step_idx", "name", F.col("value").alias("current_value"),
        F.col("_prev.value").alias("previous_value"), F.col("_prev.o.turn").alias("previous_turn"))


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """H5: one row per current claim contradicting an earlier turn's claim."""
    fc = first_conflicts(claims, ["conv_id", "subject", "predicate"])
    return fc.filter(F.col("_prev").isNotNull()).select(
        "conv_id", "turn", "step_idx", "subject", "predicate", F.col("value").alias("current_value"),
        F.col("_prev.value").alias("previous_value"), F.col("_prev.o.turn").alias("previous_turn"))


def supporting_claims(claims: DataFrame) -> DataFrame:
    """H6: per claim, the number of equal claims from earlier turns."""
    k = ["conv_id", "subject", "predicate", "object"]
    per_turn = claims.groupBy(*k, "turn").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*k).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_turn.select(*k, "turn", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("support"))
    return claims.join(earlier, k + ["turn"])


def value_changes(entities: DataFrame) -> DataFrame:
    """Per mention: the name has history in earlier turns and this value was
    never seen for it before (H11 entity_value_changes)."""
    fn = entities.groupBy("conv_id", "name").agg(F.min("turn").alias("_fn"))
    fv = entities.groupBy("conv_id", "name", "vkey").agg(F.min("turn").alias("_fv"))
    j = entities.join(fn, ["conv_id", "name"]).join(fv, ["conv_id", "name", "vkey"])
    return j.withColumn("changed", (F.col("_fn") < F.col("turn")) & ~(F.col("_fv") < F.col("turn")))


def turn_context(turns: DataFrame) -> DataFrame:
    """H8 + H9 + H10: per turn, previous turns kept in history (at most 10),
    the last 3 previous turns, their mean confidence decay (newest age 0) and
    mean turn distance; decay 1.0 / distance 0.0 without history."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn").distinct()
    prev = [F.lag("turn", i).over(w) for i in range(1, RECENT_TURNS + 1)]
    n_prev = F.row_number().over(w) - 1
    t = t.select("conv_id", "turn", n_prev.alias("n_prev"), *[p.alias(f"_p{i}") for i, p in enumerate(prev, 1)])
    k = F.least(F.col("n_prev"), F.lit(RECENT_TURNS))
    decays = [F.when(F.col(f"_p{i}").isNotNull(), 1.0 - DECAY_RATE * (i - 1)) for i in range(1, RECENT_TURNS + 1)]
    dists = [F.col("turn") - F.col(f"_p{i}") for i in range(1, RECENT_TURNS + 1)]
    ssum = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    return t.select(
        "conv_id", "turn", F.least(F.col("n_prev"), F.lit(MAX_TURNS)).cast("long").alias("num_previous_turns"),
        F.concat_ws(",", *[F.col(f"_p{i}").cast("string") for i in range(RECENT_TURNS, 0, -1)]).alias("recent_turns"),
        F.when(k == 0, 1.0).otherwise(ssum(decays) / k).alias("confidence_decay_avg"),
        F.when(k == 0, 0.0).otherwise(ssum(dists) / k).alias("turn_distance_avg"),
        F.when(k == 0, 1.0).otherwise(1.0 - DECAY_RATE * (k - 1)).alias("confidence_decay_min"))


def confidence_decay(age, base=1.0) -> F.Column:
    """Base * (1 - 0.1 * age) (may go negative, as in the reference)."""
    a = F.col(age) if isinstance(age, str) else age
    return F.lit(base) * (1.0 - DECAY_RATE * a)


def memory_features(turns: DataFrame, turn_steps: DataFrame) -> DataFrame:
    """H11 + H12 + H13 per (conv_id, turn)."""
    # each is read several times below: matched once
    ent = cut_lineage(extract_entities(turn_steps).select("conv_id", "turn", "step_idx", "pos", "name", "vkey", "value"))
    cl = cut_lineage(extract_claims(turn_steps))
    ec = entity_conflicts(ent).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_ec"))
    cc = claim_conflicts(cl).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_cc"))
    em = value_changes(ent).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("mentions"), F.sum(F.col("changed").cast("int")).alias("changes"))
    sp = supporting_claims(cl).groupBy("conv_id", "turn").agg(
        F.sum("support").alias("support"), F.count(F.lit(1)).alias("n_claims"))
    ns = turn_steps.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("num_steps"))
    ctx = turn_context(turns)
    keys = ["conv_id", "turn"]
    j = (ctx.join(ec, keys, "left").join(cc, keys, "left").join(em, keys, "left").join(sp, keys, "left")
         .join(ns, keys, "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_ec, n_cc = z("n_ec"), z("n_cc")
    steps = z("num_steps")
    raw = ENTITY_WEIGHT * n_ec + CLAIM_WEIGHT * n_cc
    score = F.when(n_ec + n_cc == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(steps > 0, raw / steps).otherwise(raw)))
    return j.select(
        "conv_id", "turn", (n_ec + n_cc).alias("num_contradictions"), (n_ec > 0).alias("has_entity_contradiction"),
        (n_cc > 0).alias("has_claim_contradiction"), z("mentions").alias("entity_mentions"),
        z("changes").alias("entity_value_changes"), z("support").alias("claim_support_count"),
        n_cc.alias("claim_conflict_count"), r6("confidence_decay_avg").alias("confidence_decay_avg"),
        r6("turn_distance_avg").alias("turn_distance_avg"), "num_previous_turns", "recent_turns",
        r6(F.when(z("mentions") > 0, 1.0 - z("changes") / z("mentions")).otherwise(1.0)).alias("entity_consistency_ratio"),
        r6(safe_div(z("support"), z("n_claims"))).alias("claim_verification_ratio"),
        r6(safe_div(n_cc, z("n_claims"))).alias("claim_conflict_ratio"),
        r6("confidence_decay_min").alias("confidence_decay_min"),
        r6(score).alias("contradiction_score"))


def mention_history(entities: DataFrame, conv_id, name: str) -> DataFrame:
    """H7: ordered mentions of one entity."""
    return (entities.filter((F.col("conv_id") == F.lit(conv_id)) & (F.col("name") == F.lit(name)))
            .orderBy("turn", "step_idx", "pos"))


def turn_buckets(steps: DataFrame) -> DataFrame:
    """Per (conv_id, turn): clean, cross_turn_error (some wrong step is
    factual) or single_turn_error.  steps: (conv_id, turn, is_correct, error_type)."""
    wrong = ~F.col("is_correct")
    g = steps.groupBy("conv_id", "turn").agg(F.max(wrong.cast("int")).alias("_e"),
                                            F.max((wrong & (F.col("error_type") == "factual")).cast("int")).alias("_f"))
    return g.select("conv_id", "turn", F.when(F.col("_e") == 0, "clean").when(F.col("_f") == 1, "cross_turn_error")
                    .otherwise("single_turn_error").alias("category"))


def bucket_metrics(steps: DataFrame, turn_index: str = "turn_idx") -> DataFrame:
    """F1 (class 1) and accuracy of ``pred`` against ``y`` for all steps,
    per H17 category and per 1-based turn index ('turn_<k>')."""
    from tracewise.operators.evaluate import binary_metrics

    cat = turn_buckets(steps)
    s = steps.join(cat, ["conv_id", "turn"])
    groups = s.select("y", "pred", F.inline(F.array(
        F.struct(F.lit("all").alias("bucket")), F.struct(F.col("category").alias("bucket")),
        F.struct(F.concat(F.lit("turn_"), (F.col(turn_index) + 1).cast("string")).alias("bucket")))))
    m = binary_metrics(groups.withColumn("score", F.col("pred").cast("double")), ["bucket"], "y", "score")
    return m.select("bucket", "f1", "accuracy", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"))


# Fixed values (reference): stop words and place suffixes of the rich extractor.
RICH_STOP = ["The", "A", "An", "And", "But", "Or"]
PLACE_SUFFIXES = ["ville", "ton", "berg", "burg", "polis", "chester"]
RICH_NAME_RE = f"\\b([A-Z][a-z]+(?:{PY_WS}+[A-Z][a-z]+)*)\\b"
RICH_NUM_RE = "\\b([0-9]+)\\b"
RICH_PLACE_RE = f"\\b([A-Z][a-z]+(?:{'|'.join(PLACE_SUFFIXES)}))\\b"


def rich_entities(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per text the entity dictionary: multi-word capitalised names
    (minus 6 stop words) -> themselves, integers -> 'number_N' with value N,
    capitalised place names with common suffixes -> themselves.  One row
    per (keys, entity); duplicates collapse like dictionary keys."""
    t = F.col(text)
    names = F.filter(F.regexp_extract_all(t, F.lit(RICH_NAME_RE), 1), lambda n: ~n.isin(RICH_STOP))
    nums = F.transform(F.regexp_extract_all(t, F.lit(RICH_NUM_RE), 1), lambda n: F.concat(F.lit("number_"), n))
    places = F.regexp_extract_all(t, F.lit(RICH_PLACE_RE), 1)
    ent = F.array_distinct(F.concat(names, nums, places))
    out = df.select(*keys, F.explode(ent).alias("entity"))
    return out.withColumn("value", F.when(F.col("entity").startswith("number_"),
                                          F.regexp_replace("entity", "^number_0*(?=.)", "")).otherwise(F.col("entity")))


def template_chain(pairs: DataFrame, keys: list[str], question: str = "question", answer: str = "answer") -> DataFrame:
    """The reference's three-step template chain for a (question, answer)
    pair; deps [], [0], [0, 1]; all steps correct.  Long form."""
    steps = F.array(
        F.struct(F.lit(0).alias("step_id"), F.concat(F.lit("I need to find the answer to: "), F.col(question)).alias("text"),
                 F.array().cast("array<int>").alias("depends_on")),
        F.struct(F.lit(1).alias("step_id"), F.lit("Looking through the story for relevant details...").alias("text"),
                 F.array(F.lit(0)).alias("depends_on")),
        F.struct(F.lit(2).alias("step_id"), F.concat(F.lit("Based on the information, the answer is: "), F.col(answer)).alias("text"),
                 F.array(F.lit(0), F.lit(1)).alias("depends_on")))
    return pairs.select(*keys, F.inline(steps)).withColumn("is_correct", F.lit(True)).withColumn("is_origin", F.lit(False))


# Fixed values (reference): replacement names, number shifts, negations, kinds.
NEW_NAMES = ["Alice", "Bob", "Charlie", "Diana", "Emma", "Frank"]
NUM_SHIFTS = [-3, -2, -1, 1, 2, 3]
NEGATIONS = [(" is ", " is not "), (" was ", " was not "), (" can ", " cannot "), (" will ", " will not ")]
INJECT_KINDS = ["entity", "claim", "buildup"]


def fault_injection(turns: DataFrame, turn_steps: DataFrame, rate: float = 0.4, seed: int = 42) -> DataFrame:
    """H16, deterministic: Python's RNG is replaced by hash draws on
    (conversation, turn).  From the second turn on, when earlier turns hold
    entities (H14, in first-seen order) and the draw is below ``rate``, one
    step other than step 0 is modified: 'entity' replaces an earlier
    entity's value (a different name, or the number shifted by ±1..3) and
    marks the step factual + origin; 'claim' negates the first matching of
    four phrases and marks it logical + origin; 'buildup' appends a note and
    keeps the labels.  Fix: ``changed`` tells whether the text really
    changed (the reference marks an entity error even when it did not).
    A turn with a single step is skipped (the reference raises there)."""
    from tracewise.functions.common import hash_key

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn", "text").withColumn("turn_idx", F.row_number().over(w) - 1)
    names = F.filter(F.regexp_extract_all("text", F.lit(RICH_NAME_RE), 1), lambda n: ~n.isin(RICH_STOP))
    nums = F.transform(F.regexp_extract_all("text", F.lit(RICH_NUM_RE), 1), lambda n: F.concat(F.lit("number_"), n))
    places = F.regexp_extract_all("text", F.lit(RICH_PLACE_RE), 1)
    ents = t.select("conv_id", "turn", F.posexplode(F.array_distinct(F.concat(names, nums, places))).alias("pos", "entity"))
    first = ents.groupBy("conv_id", "entity").agg(F.min(F.struct("turn", "pos")).alias("fs"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("fs")) - 1)
    new_per_turn = first.groupBy("conv_id", F.col("fs.turn").alias("turn")).agg(F.count(F.lit(1)).alias("_new"))
    known = (t.select("conv_id", "turn", "turn_idx").join(new_per_turn, ["conv_id", "turn"], "left")
             .withColumn("known", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    n_steps = turn_steps.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_steps"))
    key = F.col("conv_id") * 1009 + F.col("turn")
    d = (known.join(n_steps, ["conv_id", "turn"])
         .withColumn("draw", hash_key(key, seed) % 1000)
         .filter((F.col("turn_idx") > 0) & (F.col("known") > 0) & (F.col("draw") < int(rate * 1000)) & (F.col("n_steps") >= 2))
         .withColumn("step_idx", (1 + hash_key(key, seed + 1) % (F.col("n_steps") - 1)).cast("long"))
         .withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in INJECT_KINDS]), (hash_key(key, seed + 2) % 3 + 1).cast("int")))
         .withColumn("rank", hash_key(key, seed + 3) % F.col("known"))
         .withColumn("rank2", hash_key(key, seed + 4) % F.col("known"))
         .withColumn("pick", hash_key(key, seed + 5)))
    old = ranked.select("conv_id", "rank", F.col("entity").alias("old_entity"))
    note = ranked.select("conv_id", F.col("rank").alias("rank2"), F.col("entity").alias("note_entity"))
    d = d.join(old, ["conv_id", "rank"]).join(note, ["conv_id", "rank2"])
    st = turn_steps.select("conv_id", "turn", "step_idx", "text")
    x = d.join(st, ["conv_id", "turn", "step_idx"])
    is_num = F.col("old_entity").startswith("number_")
    old_v = F.when(is_num, F.regexp_replace("old_entity", "^number_0*(?=.)", "")).otherwise(F.col("old_entity"))
    cands = F.filter(F.array(*[F.lit(n) for n in NEW_NAMES]), lambda n: n != old_v)
    new_v = F.when(is_num, (old_v.cast("long") + F.element_at(F.array(*[F.lit(s) for s in NUM_SHIFTS]),
                                                               (F.col("pick") % 6 + 1).cast("int"))).cast("string")) \
        .otherwise(F.element_at(cands, (F.col("pick") % F.size(cands) + 1).cast("int")))
    low = F.lower(F.col("text"))
    neg_text = F.lit(None).cast("string")
    for pos, neg in reversed(NEGATIONS):
        neg_text = F.when(low.contains(pos), F.replace(F.col("text"), F.lit(pos), F.lit(neg))).otherwise(neg_text)
    matched = F.lit(False)
    for pos, _ in NEGATIONS:
        matched = matched | low.contains(pos)
    new_text = (F.when(F.col("kind") == "entity", F.replace(F.col("text"), old_v, new_v))
                .when(F.col("kind") == "claim", F.coalesce(neg_text, F.col("text")))
                .otherwise(F.concat(F.col("text"), F.lit(" (Note: "), F.col("note_entity"), F.lit(" was mentioned)"))))
    marked = (F.col("kind") == "entity") | ((F.col("kind") == "claim") & matched)
    return x.select("conv_id", "turn", "step_idx", "kind", new_text.alias("new_text"),
                    (new_text != F.col("text")).alias("changed"), (~marked).alias("is_correct"), marked.alias("is_origin"),
                    F.when(F.col("kind") == "entity", "factual").when(marked, "logical").alias("error_type"))
