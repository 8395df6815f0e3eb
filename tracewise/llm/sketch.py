"""Bottom-k document fingerprints, in DataFrame functions only.

A fingerprint holds the ``K`` smallest distinct 60-bit hashes of a text's 5-word shingles, in order
(a text of fewer words is one shingle; a text without words has none).  Sketches of parts merge into the
sketch of the whole; they estimate resemblance, containment and the number of distinct shingles.

Case and spacing: words are taken as they stand.  Null text: as empty, an empty sketch.  Resemblance of two
empty sketches is 1 (both sets are empty), of one empty sketch 0.  ``fingerprints_with_edits`` reads the id and the text
only, so further columns and their names don't matter; null ids come last, rows of one id stand in the order of their texts and repeated rows
are rows each; a long text is one row's array of hashes; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewise.llm.common import let, words_of

SHINGLE = 5
K = 128
BITS = 60
ROWS_PER_RANGE = 256
MAX_RANGES = 16384


def bottom_k(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the ``k`` smallest distinct shingle hashes of the text, ascending."""
    def hashes(w):
        several = F.transform(F.sequence(F.lit(1), F.size(w) - (shingle - 1)),
                              lambda i: F.shiftrightunsigned(F.xxhash64(*[F.element_at(w, i + j) for j in range(shingle)]), 64 - BITS))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", w)), 64 - BITS))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= shingle, several).when(F.size(w) > 0, whole).otherwise(none)

    return F.slice(F.sort_array(F.array_distinct(let(words_of(text), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts' shingle sets (shingles across the parts' border belong to neither)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per ``by``: distinct hashes, counted off in order; parts of a group may be many."""
    h = sketches.select(by, F.explode(sketch).alias("_h")).distinct()
    top = h.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_h"))).filter(F.col("_n") <= k)
    return top.groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the ``k`` smallest of the union, the share that both have."""
    both = let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double") / F.size(u)))
    return F.when((F.size(a) == 0) != (F.size(b) == 0), 0.0).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's size."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def as_text(sketch: Column) -> Column:
    """A fingerprint as a string: 15 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def _longs(values: list[int | None]) -> Column:
    """A constant array<bigint> made in one call, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def with_next(docs: DataFrame, doc_id: str = "doc_id", ties: tuple[str, ...] = ("text",),
              rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt so that, in the returned window, ``lead`` is the next row by descending id (after the last: the first).

    Rows go to id ranges cut at approximate quantiles.  The top row of each range is also copied
    (``_copy``) to the foot of the next higher range with rows, and the top of all to the foot of the
    lowest, so each row meets its successor inside its range: one shuffle, no global order.  Drop rows with
    ``_copy`` after use.  Null ids come last; rows with equal ids stand in order of ``ties``.
    The driver sees one number a range, at most MAX_RANGES.
    """
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // rows_per_range))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    found = docs.agg(F.percentile_approx(doc_id, shares, 4 * ranges)).first()[0] if shares else None
    cuts = sorted(set(found or []))
    step = 128
    block = F.size(F.filter(_longs(cuts[step - 1:: step]), lambda c: c <= F.col(doc_id))) * step
    place = let(block, lambda b: b + F.size(F.filter(F.slice(_longs(cuts), b + 1, step), lambda c: c <= F.col(doc_id))))
    dealt = docs.withColumn("_range", F.when(F.col(doc_id).isNull(), 0).otherwise(place).cast("int"))
    tops = sorted(dealt.groupBy("_range").agg(F.max(doc_id)).collect())
    above = {r: tops[(i + 1) % len(tops)][0] for i, (r, _) in enumerate(tops)}
    size = len(cuts) + 1
    goal = [above.get(r, 0) for r in range(size)]
    top = [dict(map(tuple, tops)).get(r) for r in range(size)]
    is_top = F.col(doc_id).eqNullSafe(F.get(_longs(top), F.col("_range")))
    own = F.struct(F.col("_range"), F.lit(False).alias("_copy"))
    foot = F.struct(F.get(_longs(goal), F.col("_range")).cast("int").alias("_range"), F.lit(True).alias("_copy"))
    dealt = dealt.select(*docs.columns, F.inline(F.when(is_top, F.array(own, foot)).otherwise(F.array(own))))
    return dealt, W.partitionBy("_range").orderBy("_copy", F.col(doc_id).desc_nulls_last(), *ties)


def fingerprints_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text, the same text with its last third replaced by the start of the next text, and their sketches.

    Returns doc_id, text, edited, sketch, edited_sketch, next_sketch.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d, order = with_next(d)
    d = d.withColumn("_next", F.lead("text").over(order))
    part = F.floor(F.length("text") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - part), F.substr("_next", F.lit(1), part))).drop("_next")
    d = d.withColumns({"sketch": bottom_k(F.col("text"), k), "edited_sketch": bottom_k(F.col("edited"), k)})
    return d.withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("_copy")).drop("_copy", "_range")
