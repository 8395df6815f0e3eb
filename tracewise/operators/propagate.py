"""Error-propagation analytics.

Inputs: steps (chain_id, idx, is_correct, is_origin), edges (chain_id, src,
dst) and predicted origins (chain_id, idx).  Distances come from one
multi-source BFS (every chain's first true origin at once); "has a wrong
descendant" comes from one multi-source BFS over reversed edges started at
the predecessors of wrong nodes.  Both are ``graph.distances``: a chain's edges packed in one row, searched inside the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.common import r6
from tracewise.operators.graph import distances
from tracewise.session import cut_lineage


def chain_summary(steps: DataFrame, edges: DataFrame, pred_origins: DataFrame) -> DataFrame:
    """Per chain: nodes, errors, first true / first predicted origin, the
    E1 membership test, and whether the chain has edges."""
    s = steps.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.sum((~F.col("is_correct")).cast("int")).cast("long").alias("num_errors"),
        F.min(F.when(F.col("is_origin"), F.col("idx"))).alias("true_origin"))
    p = pred_origins.groupBy("chain_id").agg(F.min("idx").alias("pred_origin"))
    e = edges.select("chain_id").distinct().withColumn("has_edges", F.lit(True))
    member = (pred_origins.select("chain_id", F.col("idx").alias("true_origin")).distinct()
              .withColumn("origin_in_pred", F.lit(True)))
    j = (s.join(p, "chain_id", "left").join(e, "chain_id", "left")
         .join(member, ["chain_id", "true_origin"], "left"))
    return j.select("chain_id", "num_nodes", "num_errors", "true_origin", "pred_origin",
                    F.coalesce("has_edges", F.lit(False)).alias("has_edges"),
                    (F.col("true_origin").isNotNull() & F.coalesce("origin_in_pred", F.lit(False))).alias("detected"),
                    (F.col("true_origin").isNotNull() & F.col("pred_origin").isNotNull()).alias("both_present"))


def origin_distances(summary: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed BFS distance from the first true origin, for chains with
    errors, edges and an origin.  (chain_id, node, dist)."""
    g = summary.filter((F.col("num_errors") > 0) & F.col("has_edges") & F.col("true_origin").isNotNull())
    start = g.select("chain_id", F.col("true_origin").cast("long").alias("node"))
    adj = edges.join(g.select("chain_id"), "chain_id", "left_semi").select("chain_id", "src", "dst")
    return distances(adj, start)


def depth_stats(dist: DataFrame, steps: DataFrame) -> DataFrame:
    """E5: per distance (origin = 0): nodes, wrong nodes, their ratio."""
    j = dist.join(steps.select("chain_id", F.col("idx").alias("node"), "is_correct"), ["chain_id", "node"])
    return (j.groupBy("dist").agg(F.count(F.lit(1)).alias("total"),
                                  F.sum((~F.col("is_correct")).cast("int")).cast("long").alias("errors"))
            .select(F.col("dist").alias("distance"), "total", "errors", r6(F.col("errors") / F.col("total")).alias("ratio")))


def contamination(dist: DataFrame, steps: DataFrame) -> DataFrame:
    """Per (chain, distance > 0) share of wrong nodes."""
    j = dist.filter(F.col("dist") > 0).join(steps.select("chain_id", F.col("idx").alias("node"), "is_correct"),
                                            ["chain_id", "node"])
    return j.groupBy("chain_id", "dist").agg(F.avg((~F.col("is_correct")).cast("double")).alias("ratio"))


def intervention_points(summary: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Correct nodes with at least one wrong descendant, in chains with
    errors, edges and a true origin.  (chain_id, node)."""
    g = summary.filter((F.col("num_errors") > 0) & F.col("has_edges") & F.col("true_origin").isNotNull()).select("chain_id")
    e = edges.join(g, "chain_id", "left_semi").select("chain_id", "src", "dst")
    wrong = steps.filter(~F.col("is_correct")).select("chain_id", F.col("idx").alias("dst"))
    start = e.join(wrong, ["chain_id", "dst"]).select("chain_id", F.col("src").alias("node")).distinct()
    rev = e.select("chain_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    anc = distances(rev, start).select("chain_id", "node")
    ok = steps.filter(F.col("is_correct")).select("chain_id", F.col("idx").alias("node"))
    return ok.join(anc, ["chain_id", "node"], "left_semi")


def propagation_summary(steps: DataFrame, edges: DataFrame, pred_origins: DataFrame) -> DataFrame:
    """E1 + E3 + E4 summary row."""
    summ = cut_lineage(chain_summary(steps, edges, pred_origins))  # read three times
    dist = origin_distances(summ, edges)
    cont = contamination(dist, steps)
    ip = intervention_points(summ, steps, edges)
    a = summ.agg(F.count(F.lit(1)).alias("total_graphs"),
                 F.count(F.when(F.col("num_errors") > 0, 1)).alias("graphs_with_errors"),
                 F.count(F.when((F.col("num_errors") > 0) & F.col("detected"), 1)).alias("_det"))
    c = cont.agg(F.avg("dist").alias("avg_propagation_distance"), F.avg("ratio").alias("avg_contamination_ratio"))
    i = ip.agg(F.count(F.lit(1)).alias("num_intervention_points"))
    # three single-row aggregates side by side: union into one row by position
    rows = (a.select(F.lit(0).alias("_k"), "total_graphs", "graphs_with_errors", "_det",
                     F.lit(None).cast("double").alias("avg_propagation_distance"),
                     F.lit(None).cast("double").alias("avg_contamination_ratio"), F.lit(None).cast("long").alias("num_intervention_points"))
            .unionByName(c.select(F.lit(0).alias("_k"), F.lit(None).cast("long").alias("total_graphs"),
                                  F.lit(None).cast("long").alias("graphs_with_errors"), F.lit(None).cast("long").alias("_det"),
                                  "avg_propagation_distance", "avg_contamination_ratio",
                                  F.lit(None).cast("long").alias("num_intervention_points")))
            .unionByName(i.select(F.lit(0).alias("_k"), F.lit(None).cast("long").alias("total_graphs"),
                                  F.lit(None).cast("long").alias("graphs_with_errors"), F.lit(None).cast("long").alias("_det"),
                                  F.lit(None).cast("double").alias("avg_propagation_distance"),
                                  F.lit(None).cast("double").alias("avg_contamination_ratio"), "num_intervention_points")))
    r = rows.groupBy("_k").agg(*[F.max(c).alias(c) for c in ["total_graphs", "graphs_with_errors", "_det",
                                                            "avg_propagation_distance", "avg_contamination_ratio",
                                                            "num_intervention_points"]])
    return r.select("total_graphs", "graphs_with_errors",
                    r6(F.col("_det") / F.greatest(F.col("graphs_with_errors"), F.lit(1))).alias("origin_detection_rate"),
                    r6(F.coalesce("avg_propagation_distance", F.lit(0.0))).alias("avg_propagation_distance"),
                    r6(F.coalesce("avg_contamination_ratio", F.lit(0.0))).alias("avg_contamination_ratio"),
                    F.coalesce("num_intervention_points", F.lit(0)).cast("long").alias("num_intervention_points"))


def per_graph_sample(summary: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` graphs (by chain id) having errors and edges:
    nodes, errors, origin_detected (both sets non-empty, as the reference's
    per-graph flag), origin_in_pred (the rate's membership test), first true
    and first predicted origin or -1.  The limit is the feature (a sample)."""
    g = summary.filter((F.col("num_errors") > 0) & F.col("has_edges"))
    return (g.orderBy("chain_id").limit(n)
            .select(F.col("chain_id").alias("graph_id"), "num_nodes", "num_errors",
                    F.col("both_present").alias("origin_detected"), F.col("detected").alias("origin_in_pred"),
                    F.coalesce("true_origin", F.lit(-1)).cast("long").alias("true_origin"),
                    F.coalesce("pred_origin", F.lit(-1)).cast("long").alias("pred_origin")))
