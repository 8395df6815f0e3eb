"""Per-chain graph construction and topology features.

Graphs are edge tables keyed by ``chain_id``.  A chain's graph fits one row, so the topology measures (G2–G6) and distances run on
arrays, all chains of a task at once and without a Spark job a level (``chain_arrays``).  Chains of more than ``limit`` nodes and edges go
through joins, with the same results:

* reachability / distances – semi-naive frontier BFS, one join + anti-join per level, several levels a job; lineage cut with
  reliable checkpoints into ``spark.checkpoint.dir``
* degrees, triangles – group-bys and an edge self-join in degree order
* longest path – nodes peeled off as their in-degrees run out, each joined to its edges once
* betweenness – Brandes' dependency accumulation as joins over the (source, node, dist, sigma) BFS table
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.common import r6, safe_div
from tracewise.operators import chain_arrays as A
from tracewise.session import cut_lineage


HOPS = 2  # levels a job


def bfs_levels(adj: DataFrame, start: DataFrame, key_cols: tuple[str, ...] = ("chain_id",),
               max_rounds: int | None = None) -> DataFrame:
    """Directed BFS distances.

    adj:   (*key_cols, src, dst)   start: (*key_cols, node)
    returns (*key_cols, node, dist) for every reachable node (dist 0 = start).
    ``key_cols`` may include a source column to run many BFS at once.
    """
    keys = list(key_cols)
    # partitioned on the join keys once: checkpoints keep their partitioning,
    # so each level shuffles only the (shrinking) frontier, not the edges
    nparts = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = cut_lineage(adj.select(*keys, F.col("src").alias("node"), "dst").distinct()
                    .repartition(nparts, *keys, "node"))
    visited = cut_lineage(start.select(*keys, "node").distinct().withColumn("dist", F.lit(0).cast("long")))
    frontier = visited.select(*keys, "node")
    level = 0
    # HOPS levels run in one job: each is persisted, so the next ones read it instead of computing it again.  Then
    # the lineage is cut (reliable checkpoint); without that the plan embeds all earlier levels.
    while max_rounds is None or level < max_rounds:
        seen, hops = visited.select(*keys, "node"), []
        for _ in range(HOPS if max_rounds is None else min(HOPS, max_rounds - level)):
            level += 1
            nxt = (frontier.join(a, keys + ["node"]).select(*keys, F.col("dst").alias("node")).distinct()
                   .join(seen, keys + ["node"], "left_anti").persist())
            hops.append((level, nxt))
            seen, frontier = seen.unionByName(nxt), nxt
        new = _cut_hops([(n.withColumn("dist", F.lit(k).cast("long")), n) for k, n in hops])
        visited = visited.unionByName(new)
        frontier = new.filter(F.col("dist") == level).select(*keys, "node")
        if frontier.isEmpty():
            break
    return visited


def distances(edges: DataFrame, starts: DataFrame, limit: int = A.ROW_ENDS) -> DataFrame:
    """(chain_id, node, dist): hops along (chain_id, src, dst) from the nearest of a chain's starts (chain_id, node), of every node reached."""
    (e, s), long = A.split_long([edges.select("chain_id", "src", "dst"), starts.select("chain_id", "node")], limit)
    out = A.reached(e, s)
    return out if long is None else out.unionByName(bfs_levels(*long))


def _cut_hops(hops: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Union of the levels (first of each pair), cut from its parents; the persisted ones (second) are released."""
    out = hops[0][0]
    for h, _ in hops[1:]:
        out = out.unionByName(h)
    out = cut_lineage(out)
    for _, held in hops:
        held.unpersist()
    return out


# ---------------------------------------------------------------------------
# G1: node / edge tables
# ---------------------------------------------------------------------------

# Label encodings of the reference.
ERROR_CODES = {"factual": 1, "logical": 2, "syntax": 3}
DOMAIN_CODES = {"math": 0, "code": 1, "medical": 2}


def node_table(steps: DataFrame) -> DataFrame:
    """G1 nodes: labels as floats; error type none/unknown=0, factual=1,
    logical=2, syntax=3; domain math 0 / code 1 / medical 2 (unknown 0)."""
    et = F.lower(F.coalesce(F.col("error_type"), F.lit("")))
    dom = F.lower(F.coalesce(F.col("domain"), F.lit("")))
    et_code = F.lit(0)
    for k, v in ERROR_CODES.items():
        et_code = F.when(et == k, v).otherwise(et_code)
    dm_code = F.lit(0)
    for k, v in DOMAIN_CODES.items():
        dm_code = F.when(dom == k, v).otherwise(dm_code)
    return steps.select("chain_id", "idx", F.col("is_correct").cast("double").alias("y"),
                        F.col("is_origin").cast("double").alias("y_origin"), et_code.cast("long").alias("y_error_type"),
                        dm_code.cast("long").alias("domain_id"))


def edge_table(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """G1 edges: the chain's 2-element edges with weight 1; a chain without
    any valid edge gets sequential edges (i, i+1).  edges: (chain_id, edge)."""
    valid = edges.filter(F.size("edge") == 2).select("chain_id", F.col("edge")[0].alias("src"), F.col("edge")[1].alias("dst"))
    seq = (steps.filter(F.col("idx") >= 1).select("chain_id", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
           .join(valid.select("chain_id").distinct(), "chain_id", "left_anti"))
    return valid.unionByName(seq).withColumn("weight", F.lit(1.0))


# ---------------------------------------------------------------------------
# G2–G6 together
# ---------------------------------------------------------------------------

def topology(nodes: DataFrame, edges: DataFrame, measures: tuple[str, ...] = tuple(A.KINDS), root: int = 0, limit: int = A.ROW_ENDS) -> DataFrame:
    """(chain_id, node, *measures) of every node, all measures from one packing of the chains: in_deg, out_deg, clustering,
    path_length (from ``root``), betweenness, max_depth (the chain's)."""
    nodes, edges = nodes.select("chain_id", "node"), edges.select("chain_id", "src", "dst")
    (n, e), long = A.split_long([nodes, edges], limit)
    out = A.node_measures(n, e, measures, root)
    if long is not None:
        n, e = cut_lineage(long[0].distinct()), cut_lineage(long[1].distinct())
        more, deg = n, None
        for m in measures:
            if m in ("in_deg", "out_deg"):
                deg = _degrees_by_joins(n, e) if deg is None else deg
                part = deg.select("chain_id", "node", m)
            elif m == "max_depth":
                part = _longest_by_joins(n, e).select("chain_id", "max_depth")
            else:
                part = {"clustering": _clustering_by_joins, "betweenness": _betweenness_by_joins,
                        "path_length": lambda x, y: _root_by_joins(x, y, root)}[m](n, e)
            more = more.join(part, ["chain_id"] if m == "max_depth" else ["chain_id", "node"])
        out = out.unionByName(more.select(out.columns))
    return out.select("chain_id", "node", *[(r6(m) if A.KINDS[m] == "double" else F.col(m)).alias(m) for m in measures])


# ---------------------------------------------------------------------------
# Degrees and clustering
# ---------------------------------------------------------------------------

def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in/out degree over distinct edges (0 for isolated nodes)."""
    return topology(nodes, edges, ("in_deg", "out_deg"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected clustering 2T/(d(d-1)) (0 if d < 2), self-loops ignored."""
    return topology(nodes, edges, ("clustering",))


def _degrees_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select("chain_id", "src", "dst").distinct()
    outd = e.groupBy("chain_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_deg"))
    ind = e.groupBy("chain_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_deg"))
    return (nodes.select("chain_id", "node").join(ind, ["chain_id", "node"], "left").join(outd, ["chain_id", "node"], "left")
            .select("chain_id", "node", F.coalesce("in_deg", F.lit(0)).cast("long").alias("in_deg"),
                    F.coalesce("out_deg", F.lit(0)).cast("long").alias("out_deg")))


def _clustering_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles are counted with degree ordering: every undirected edge is
    oriented from its lower-(degree, id) end, wedges are formed only from
    out-neighbour pairs (out-degree <= sqrt(2m)), and closed by an
    equi-join.  A hub node therefore never expands into deg^2 wedges."""
    e = edges.select("chain_id", "src", "dst").filter(F.col("src") != F.col("dst"))
    und = (e.select("chain_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    deg = (und.select("chain_id", F.col("a").alias("v")).unionAll(und.select("chain_id", F.col("b").alias("v")))
           .groupBy("chain_id", "v").agg(F.count(F.lit(1)).alias("d")))
    da = deg.select("chain_id", F.col("v").alias("a"), F.col("d").alias("da"))
    db = deg.select("chain_id", F.col("v").alias("b"), F.col("d").alias("db"))
    o = und.join(da, ["chain_id", "a"]).join(db, ["chain_id", "b"])
    a_first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    orient = o.select("chain_id", F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("u"),
                      F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("w"))
    o1 = orient.select("chain_id", "u", F.col("w").alias("x"))
    o2 = orient.select("chain_id", "u", F.col("w").alias("y"))
    wedges = o1.join(o2, ["chain_id", "u"]).filter(F.col("x") < F.col("y"))
    tri = wedges.join(und.select("chain_id", F.col("a").alias("x"), F.col("b").alias("y")), ["chain_id", "x", "y"])
    per_node = (tri.select("chain_id", F.explode(F.array("u", "x", "y")).alias("v"))
                .groupBy("chain_id", "v").agg(F.count(F.lit(1)).alias("t")))
    j = (nodes.select("chain_id", F.col("node").alias("v")).join(deg, ["chain_id", "v"], "left")
         .join(per_node, ["chain_id", "v"], "left"))
    d = F.coalesce(F.col("d"), F.lit(0))
    c = F.when(d < 2, 0.0).otherwise(2.0 * F.coalesce(F.col("t"), F.lit(0)) / (d * (d - 1)))
    return j.select("chain_id", F.col("v").alias("node"), r6(c).alias("clustering"))


# ---------------------------------------------------------------------------
# Distances from the root, longest path
# ---------------------------------------------------------------------------

def root_distance(nodes: DataFrame, edges: DataFrame, root: int = 0) -> DataFrame:
    """Directed hops from node ``root``; -1 when unreachable."""
    return topology(nodes, edges, ("path_length",), root)


def _root_by_joins(nodes: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    start = nodes.filter(F.col("node") == root)
    d = bfs_levels(edges, start)
    return (nodes.join(d, ["chain_id", "node"], "left")
            .select("chain_id", "node", F.coalesce("dist", F.lit(-1)).cast("long").alias("path_length")))


def longest_paths(nodes: DataFrame, edges: DataFrame, limit: int = A.ROW_ENDS) -> DataFrame:
    """Per chain the longest path length in edges; a cyclic chain gets
    n - 1 (networkx raises and the reference falls back); empty -> 0."""
    (n, e), long = A.split_long([nodes.select("chain_id", "node"), edges.select("chain_id", "src", "dst")], limit)
    out = A.chain_depths(n, e)
    return out if long is None else out.unionByName(_longest_by_joins(*long))


def _longest_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Peels off the nodes whose in-edges have all been passed on, level by level: each node is joined to its out-edges once,
    and its depth is the largest that it was handed, plus one.  Nodes that are never peeled lie on or behind a cycle."""
    e = cut_lineage(edges.select("chain_id", "src", "dst").distinct())
    nodes = nodes.select("chain_id", "node").distinct()
    every = nodes.unionByName(e.select("chain_id", F.col("src").alias("node"))).unionByName(e.select("chain_id", F.col("dst").alias("node"))).distinct()
    waits = e.groupBy("chain_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    left = every.join(waits, ["chain_id", "node"], "left").select("chain_id", "node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("long").alias("depth"))
    left, peeled = cut_lineage(left), None
    while True:
        front = left.filter("waits = 0")
        gone = front.groupBy("chain_id").agg(F.max("depth").alias("depth"))
        peeled = gone if peeled is None else peeled.unionByName(gone).groupBy("chain_id").agg(F.max("depth").alias("depth"))
        peeled = cut_lineage(peeled)
        if front.isEmpty():
            break
        handed = (front.withColumnRenamed("node", "src").join(e, ["chain_id", "src"])
                  .groupBy("chain_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), (F.max("depth") + 1).alias("_d")))
        left = cut_lineage(left.filter("waits > 0").join(handed, ["chain_id", "node"], "left").select(
            "chain_id", "node", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), F.greatest("depth", F.coalesce("_d", F.lit(0))).alias("depth")))
    cyclic = left.select("chain_id").distinct().withColumn("cyclic", F.lit(True))
    n = nodes.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(peeled, "chain_id", "left").join(cyclic, "chain_id", "left")
    return j.select("chain_id", F.col("cyclic").isNull().alias("is_dag"),
                    F.when(F.col("cyclic"), F.col("n") - 1).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("max_depth"))


# ---------------------------------------------------------------------------
# Betweenness (Brandes, directed, normalised)
# ---------------------------------------------------------------------------

def shortest_path_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain_id, s, v, d, sigma): BFS from every source with the number of
    shortest paths, level by level (semi-naive; each level checkpointed)."""
    a = cut_lineage(edges.select("chain_id", F.col("src").alias("v"), "dst").distinct())
    lvl = cut_lineage(nodes.select("chain_id", F.col("node").alias("s"), F.col("node").alias("v"))
                      .withColumn("sigma", F.lit(1.0)).withColumn("d", F.lit(0)))
    out = lvl
    d = 0
    while True:
        seen, hops = out.select("chain_id", "s", "v"), []
        for _ in range(HOPS):
            d += 1
            nxt = (lvl.join(a, ["chain_id", "v"]).groupBy("chain_id", "s", F.col("dst").alias("v"))
                   .agg(F.sum("sigma").alias("sigma"))
                   .join(seen, ["chain_id", "s", "v"], "left_anti").withColumn("d", F.lit(d)).persist())
            hops.append((nxt, nxt))
            seen, lvl = seen.unionByName(nxt.select("chain_id", "s", "v")), nxt
        new = _cut_hops(hops)
        out = out.unionByName(new)
        lvl = new.filter(F.col("d") == d)
        if lvl.isEmpty():
            return out


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Brandes' betweenness along the edges, normalised by 1/((n-1)(n-2)) (0 when n <= 2), as networkx does for directed graphs."""
    return topology(nodes, edges, ("betweenness",))


def _betweenness_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum over s != v != t of sigma_st(v)/sigma_st, via Brandes'
    dependency recursion delta_s(v) = sum_{w: v pred of w} sigma_sv/sigma_sw (1 + delta_s(w)),
    evaluated from the deepest BFS level upwards; normalised by
    1/((n-1)(n-2))."""
    p = shortest_path_counts(nodes, edges)
    e = edges.select("chain_id", F.col("src").alias("v"), F.col("dst").alias("w")).distinct()
    maxd = p.agg(F.max("d")).first()[0] or 0
    # predecessor pairs on shortest-path DAGs: (s, v, w) with d(w) = d(v) + 1
    pv = p.select("chain_id", "s", "v", F.col("d").alias("dv"), F.col("sigma").alias("sv"))
    pw = p.select("chain_id", "s", F.col("v").alias("w"), F.col("d").alias("dw"), F.col("sigma").alias("sw"))
    pairs = cut_lineage(pv.join(e, ["chain_id", "v"]).join(pw, ["chain_id", "s", "w"])
                        .filter(F.col("dw") == F.col("dv") + 1).select("chain_id", "s", "v", "w", "dv", "sv", "sw"))
    delta = None  # (chain_id, s, w, delta) of the level below
    acc = []
    for lv in range(maxd - 1, -1, -1):
        lvl_pairs = pairs.filter(F.col("dv") == lv)
        if delta is None:
            contrib = lvl_pairs.withColumn("dw_", F.lit(0.0))
        else:
            contrib = lvl_pairs.join(delta.select("chain_id", "s", F.col("v").alias("w"), F.col("delta").alias("dw_")),
                                     ["chain_id", "s", "w"], "left").fillna(0.0, ["dw_"])
        delta = contrib.groupBy("chain_id", "s", "v").agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("dw_"))).alias("delta")).persist()
        acc.append((delta.filter(F.col("s") != F.col("v")), delta))
    n = nodes.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    if acc:
        bc = _cut_hops(acc).groupBy("chain_id", "v").agg(F.sum("delta").alias("bc"))
    else:
        bc = nodes.select("chain_id", F.col("node").alias("v")).withColumn("bc", F.lit(0.0)).limit(0)
    j = (nodes.select("chain_id", F.col("node").alias("v")).join(bc, ["chain_id", "v"], "left").join(n, "chain_id"))
    norm = F.when(F.col("n") > 2, F.coalesce("bc", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return j.select("chain_id", F.col("v").alias("node"), r6(norm).alias("betweenness"))


# ---------------------------------------------------------------------------
# G7, G8, G12–G16
# ---------------------------------------------------------------------------

def task_features(steps: DataFrame, depth: DataFrame) -> DataFrame:
    """Domain one-hot (3), chain depth, position idx/max(n-1, 1), 0.5.  ``depth``: one row a chain, or one a node (``topology``)."""
    n = steps.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_n"))
    if "node" in depth.columns:
        s = steps.join(n, "chain_id").join(depth.select("chain_id", F.col("node").alias("idx"), "max_depth"), ["chain_id", "idx"], "left")
    else:
        s = steps.join(n, "chain_id").join(depth.select("chain_id", "max_depth"), "chain_id", "left")
    dom = F.lower(F.col("domain"))
    return s.select("chain_id", "idx",
                    (dom == "math").cast("double").alias("is_math"), (dom == "code").cast("double").alias("is_code"),
                    (dom == "medical").cast("double").alias("is_medical"),
                    F.coalesce("max_depth", F.lit(0)).cast("double").alias("depth"),
                    r6(F.col("idx") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("position"),
                    F.lit(0.5).alias("factual_density"))


def assemble_features(blocks: list[DataFrame], cols: list[list[str]]) -> DataFrame:
    """Concatenate feature blocks keyed by (chain_id, idx) into one
    array; with no block a single zero column is produced."""
    if not blocks:
        raise ValueError("need at least the node keys")
    out = blocks[0].select("chain_id", "idx", F.array(*[F.col(c).cast("double") for c in cols[0]] or [F.lit(0.0)]).alias("features"))
    for b, c in zip(blocks[1:], cols[1:]):
        arr = F.array(*[F.col(x).cast("double") for x in c])
        out = out.join(b.select("chain_id", "idx", arr.alias("_f")), ["chain_id", "idx"]).select(
            "chain_id", "idx", F.concat("features", "_f").alias("features"))
    return out


def graph_stats(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, avg_degree = 2E/max(n,1), density = E/(n(n-1)),
    is_dag, max_depth, num_errors, error_rate, has_origin, origin_position."""
    nodes = steps.select("chain_id", F.col("idx").alias("node"))
    lp = longest_paths(nodes, edges)
    s = steps.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.sum((~F.col("is_correct")).cast("int")).cast("long").alias("num_errors"),
        F.min(F.when(F.col("is_origin"), F.struct("idx", "step_id"))).alias("_o"))
    ne = edges.groupBy("chain_id").agg(F.count(F.lit(1)).alias("num_edges"))
    j = s.join(ne, "chain_id", "left").join(lp, "chain_id", "left")
    n = F.col("num_nodes")
    e = F.coalesce("num_edges", F.lit(0))
    return j.select("chain_id", "num_nodes", e.cast("long").alias("num_edges"),
                    r6(2.0 * e / F.greatest(n, F.lit(1))).alias("avg_degree"),
                    r6(F.when(n > 1, e / (n * (n - 1))).otherwise(0.0)).alias("density"),
                    "is_dag", "max_depth", "num_errors", r6(F.col("num_errors") / F.greatest(n, F.lit(1))).alias("error_rate"),
                    F.col("_o").isNotNull().alias("has_origin"), F.col("_o.step_id").alias("origin_position"))


def domain_comparison(stats: DataFrame, chains: DataFrame) -> DataFrame:
    """Per domain chains, mean nodes / edges / depth / error rate."""
    return (stats.join(chains.select("chain_id", "domain"), "chain_id").groupBy("domain")
            .agg(F.count(F.lit(1)).alias("num_chains"), r6(F.avg("num_nodes")).alias("avg_nodes"),
                 r6(F.avg("num_edges")).alias("avg_edges"), r6(F.avg("max_depth")).alias("avg_depth"),
                 r6(F.avg("error_rate")).alias("avg_error_rate")))


def histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """Numpy-style equal-width histogram over [min, max] (last bin
    closed; a constant column uses [v-0.5, v+0.5]).  The range is one
    two-number aggregate read on the driver; binning is a group-by."""
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return values.sparkSession.createDataFrame([], "bin long, lower double, upper double, n long")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return (values.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", r6(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    r6(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n"))


def node_roles(steps: DataFrame) -> DataFrame:
    """Origin / propagated (wrong, not origin) / correct."""
    return steps.select("chain_id", "idx", F.when(F.col("is_origin"), "origin")
                        .when(~F.col("is_correct"), "propagated").otherwise("correct").alias("role"))


# ---------------------------------------------------------------------------
# Semantic edges and edge-set evaluation
# ---------------------------------------------------------------------------

TILE = 512  # vectors of a chain on each side of a product
SHORT = 16  # coordinates of the projection that bounds a cosine


def _tile_edges(threshold: float):
    """Edges of a tile of vectors, and how many of its pairs were possible and tested."""
    kind = pa.struct([("src", pa.int64()), ("dst", pa.int64()), ("cosine", pa.float64())])

    def unit(vectors: pa.Array, n: int) -> np.ndarray:
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def one(mine: pa.Array, other: pa.Array, diagonal: bool) -> tuple[list, int, int]:
        a_at, b_at = (x.field(0).to_numpy() for x in (mine, other))
        a, b = unit(mine.field(1), len(mine)), unit(other.field(1), len(other))
        pairs = (a_at[:, None] < b_at) if diagonal else np.ones((len(a), len(b)), bool)
        possible = int(pairs.sum())
        if a.shape[1] > SHORT:
            # a.b = short parts' product + rests' product, and that is at most the product of the rests' lengths
            rest = [np.sqrt((x[:, SHORT:] ** 2).sum(axis=1)) for x in (a, b)]
            pairs &= a[:, :SHORT] @ b[:, :SHORT].T + np.outer(*rest) >= threshold - 1e-9
        i, j = np.nonzero(pairs)
        # few left: their products alone; many: one product of matrices
        cosine = np.einsum("ij,ij->i", a[i], b[j]) if 4 * len(i) < possible else (a @ b.T)[i, j]
        keep = cosine >= threshold
        return [{"src": s, "dst": d, "cosine": c} for s, d, c in zip(a_at[i[keep]].tolist(), b_at[j[keep]].tolist(), cosine[keep].tolist())], possible, len(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, other = (batch.column(c)[k].values for c in (2, 3))
                edges, possible, tested = one(mine, other if len(other) else mine, not len(other))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([edges], pa.list_(kind)), pa.array([possible]), pa.array([tested])],
                                                 ["chain_id", "edges", "possible", "tested"])

    return run


def semantic_tiles(vec_steps: DataFrame, threshold: float = 0.7) -> DataFrame:
    """G9 by tiles: (chain_id, edges array<src, dst, cosine>, possible, tested), one row for each pair of a chain's blocks of TILE steps.

    A block is sent once to each block behind it, so a vector moves n / TILE times and no pair of vectors is a row.  Before the
    product, a projection on SHORT coordinates with the lengths of what it leaves out bounds each cosine from above
    (Cauchy-Schwarz); only pairs whose bound reaches the threshold are tested, so nothing is lost."""
    v = vec_steps.select("chain_id", F.floor(F.col("idx") / TILE).alias("_b"), F.struct(F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("v")).alias("_x"))
    last = v.groupBy("chain_id").agg(F.max("_b").alias("_last"))
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    before = F.transform(F.sequence(F.lit(0), F.col("_b")), lambda i: place(i, F.col("_b")))
    behind = F.transform(F.sequence(F.col("_b"), F.col("_last")), lambda j: place(F.col("_b"), j))
    dealt = v.join(last, "chain_id").select("chain_id", "_b", "_x", F.inline(F.array_distinct(F.concat(before, behind))))
    side = lambda b: F.collect_list(F.when(b, F.col("_x")))
    tiles = dealt.groupBy("chain_id", "i", "j").agg(side(F.col("_b") == F.col("i")).alias("mine"), side((F.col("_b") == F.col("j")) & (F.col("i") < F.col("j"))).alias("other"))
    kind = vec_steps.schema["chain_id"].dataType.simpleString()
    return tiles.select("chain_id", "i", "mine", "other").mapInArrow(
        _tile_edges(threshold), f"chain_id {kind}, edges array<struct<src:bigint,dst:bigint,cosine:double>>, possible long, tested long")


def semantic_edges(vec_steps: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(chain_id, src, dst, cosine) for i < j in a chain with cosine >= threshold (0 for a zero vector)."""
    return semantic_tiles(vec_steps, threshold).select("chain_id", F.inline("edges")).select("chain_id", "src", "dst", r6("cosine").alias("cosine"))


def enhance_edges(existing: DataFrame, vec_steps: DataFrame | None, method: str = "semantic",
                  threshold: float = 0.7) -> DataFrame:
    """Semantic / hybrid add similar pairs to the existing edges (union,
    deduplicated); nli and llm return the existing edges unchanged, as the
    reference's stubs do."""
    base = existing.select("chain_id", "src", "dst")
    if method in ("nli", "llm") or vec_steps is None:
        return base.distinct()
    if method in ("semantic", "hybrid"):
        return base.unionByName(semantic_edges(vec_steps, threshold).select("chain_id", "src", "dst")).distinct()
    return base.distinct()


def edge_set_eval(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per chain with gold edges TP/FP/FN -> P/R/F1 (0 on zero
    denominators); means over those chains."""
    p = pred.select("chain_id", "src", "dst").distinct().withColumn("_p", F.lit(1))
    g = gold.select("chain_id", "src", "dst").distinct().withColumn("_g", F.lit(1))
    j = p.join(g, ["chain_id", "src", "dst"], "full")
    per = j.groupBy("chain_id").agg(
        F.sum((F.col("_p").isNotNull() & F.col("_g").isNotNull()).cast("int")).alias("tp"),
        F.sum((F.col("_p").isNotNull() & F.col("_g").isNull()).cast("int")).alias("fp"),
        F.sum((F.col("_p").isNull() & F.col("_g").isNotNull()).cast("int")).alias("fn"))
    per = per.join(g.select("chain_id").distinct(), "chain_id", "left_semi")
    pr = safe_div("tp", F.col("tp") + F.col("fp"))
    rc = safe_div("tp", F.col("tp") + F.col("fn"))
    per = per.select("chain_id", pr.alias("p"), rc.alias("r"), safe_div(2 * pr * rc, pr + rc).alias("f1"))
    return per.agg(r6(F.avg("p")).alias("precision"), r6(F.avg("r")).alias("recall"), r6(F.avg("f1")).alias("f1"),
                   F.count(F.lit(1)).alias("n_chains"))


# ---------------------------------------------------------------------------
# Neighbourhood aggregation, pooling, attention heat map
# ---------------------------------------------------------------------------

def neighbour_mean(feats: DataFrame, edges: DataFrame, vector: str = "embedding", rounds: int = 2, gate: str | None = None) -> DataFrame:
    """``rounds`` of h <- h + g * mean(h over in-neighbours) (0 without in-neighbours); g = sigmoid(gate column) when
    given, else 1.  No learned weights: the relational skeleton of message passing.  ``vector`` is an array of any one
    length; it is averaged as one vector.  Returns (chain_id, idx, h array<double>)."""
    e = edges.select("chain_id", "src", "dst").distinct()
    g = F.lit(1.0) if not gate else 1.0 / (1.0 + F.exp(-F.col(gate)))
    h = feats.select("chain_id", "idx", F.col(vector).cast("array<double>").alias("h"), g.alias("g"))
    for _ in range(rounds):
        mean = (e.join(h.select("chain_id", F.col("idx").alias("src"), array_to_vector("h").alias("v")), ["chain_id", "src"])
                .groupBy("chain_id", F.col("dst").alias("idx")).agg(Summarizer.mean(F.col("v")).alias("v"))
                .select("chain_id", "idx", vector_to_array("v").alias("m")))
        h = h.join(mean, ["chain_id", "idx"], "left").select("chain_id", "idx", F.when(F.col("m").isNull(), F.col("h")).otherwise(
            F.zip_with("h", F.transform("m", lambda x: x * F.col("g")), lambda x, y: x + y)).alias("h"), "g")
    return h.select("chain_id", "idx", "h")


def mean_pool(feats: DataFrame, vector: str = "h") -> DataFrame:
    """Average node vector per chain (chain_id, h array<double>)."""
    return feats.groupBy("chain_id").agg(Summarizer.mean(array_to_vector(vector)).alias("v")).select("chain_id", vector_to_array("v").alias("h"))


def attention_heatmap(attn: DataFrame, steps: DataFrame, label_chars: int | None = None) -> DataFrame:
    """Mean over heads per edge, then the sum per target node (not
    normalised); nodes without incoming attention get 0; label
    'Step i: text' (with ``label_chars``: that many characters and '...')."""
    text = F.col("text") if label_chars is None else F.concat(F.substring("text", 1, label_chars), F.lit("..."))
    per_edge = attn.groupBy("chain_id", "src", "dst").agg(F.avg("alpha").alias("a"))
    per_node = per_edge.groupBy("chain_id", F.col("dst").alias("idx")).agg(F.sum("a").alias("attention"))
    return (steps.select("chain_id", "idx", "text").join(per_node, ["chain_id", "idx"], "left")
            .select("chain_id", "idx", r6(F.coalesce("attention", F.lit(0.0))).alias("attention"),
                    F.concat(F.lit("Step "), F.col("idx").cast("string"), F.lit(": "), text).alias("label")))
