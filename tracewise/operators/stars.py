"""Connected components of many graphs by alternating large-star and small-star steps.

Edges are keyed by chain, so one run labels the graphs of all chains at once.  A step is a minimum per node (combined before
the shuffle) and a join back; the number of rounds grows with the logarithm of the longest path, however long a chain is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.session import cut_lineage

KEY = ["chain_id", "n"]


def _mark(edges: DataFrame) -> tuple:
    row = F.xxhash64("chain_id", "n", "m").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(row)).first())


def components(edges: DataFrame, on_round: Callable[[int, int], None] | None = None) -> DataFrame:
    """(chain_id, src, dst), read as undirected -> (chain_id, node, component): the least node that it reaches, for every node of an edge.

    ``on_round`` hears of each round and the number of links then left.
    """
    nodes = edges.select("chain_id", F.col("src").alias("node")).unionByName(edges.select("chain_id", F.col("dst").alias("node"))).distinct()
    links = cut_lineage(edges.filter("src <> dst").select("chain_id", F.greatest("src", "dst").alias("n"), F.least("src", "dst").alias("m")).distinct())
    mark, rounds = _mark(links), 0
    while mark[0]:
        rounds += 1
        both = links.unionByName(links.select("chain_id", F.col("m").alias("n"), F.col("n").alias("m")))
        least = both.groupBy(KEY).agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
        large = cut_lineage(both.filter("m > n").join(least, KEY).select("chain_id", F.col("m").alias("n"), F.col("least").alias("m")).distinct())
        least = large.groupBy(KEY).agg(F.min("m").alias("least"))
        moved = large.join(least, KEY).filter("m <> least").select("chain_id", F.col("m").alias("n"), F.col("least").alias("m"))
        links = cut_lineage(moved.unionByName(least.select("chain_id", "n", F.col("least").alias("m"))).distinct())
        new = _mark(links)
        if on_round:
            on_round(rounds, new[0])
        if new == mark:
            break
        mark = new
    named = links.select("chain_id", F.col("n").alias("node"), F.col("m").alias("component"))
    return nodes.join(named, ["chain_id", "node"], "left").select("chain_id", "node", F.coalesce("component", "node").alias("component"))
