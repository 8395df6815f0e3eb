"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one minimum per node (combined before the shuffle) and one join back, so a hub of any degree is
spread over tasks; tables are written between steps.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import materialise


def _mark(links: DataFrame) -> tuple:
    """Number of links and an order-free checksum."""
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node that it reaches, for every node of a link."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        # large star: every greater neighbour of a node goes to the node's least neighbour
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b")).distinct()
        large = materialise(large, "large")
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(least, "a")
        small = moved.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        small = materialise(small.distinct(), "small")
        new = _mark(small)
        edges = small
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
