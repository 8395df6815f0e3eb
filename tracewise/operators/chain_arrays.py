"""Graph measures of many chains at once, on arrays.

``pack`` brings a chain's nodes and edges together in one row (one shuffle).  The measures then run inside the tasks,
over the graphs of all chains of an Arrow batch side by side: each step of a search is a few numpy operations on all of
them, so a batch costs as many steps as its deepest graph, and no search takes a Spark job a level.

* distances: breadth first from any number of starts a chain, along the edges or both ways
* longest paths: nodes are peeled off as their in-degrees run out, each once; what is left over lies on or behind a cycle
* betweenness: Brandes, all sources of a block of (source, node) pairs at a time, forward by levels and back again
* clustering: triangles by degree ordering

A row holds at most ROW_ENDS nodes, edges and starts; an Arrow batch at most ``spark.sql.execution.arrow.maxBytesPerBatch`` of
rows.  Callers send longer chains through joins instead (``split_long``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small

ROW_ENDS = 1_000_000
PAIRS = 2_000_000  # (source, node) pairs, and wedges, that are held at a time


def _rows(nodes: DataFrame | None, edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    none = F.lit(None).cast("long")
    rows = edges.select("chain_id", F.lit(1).alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    for kind, part in ((0, nodes), (2, starts)):
        if part is not None:
            rows = rows.unionByName(part.select("chain_id", F.lit(kind).alias("kind"), F.col("node").cast("long").alias("a"), none.alias("b")))
    return rows


def split_long(tables: list[DataFrame], limit: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables without the chains that have more than ``limit`` rows in all of them together, and with only those (None: no such chain)."""
    ends = tables[0].select("chain_id")
    for t in tables[1:]:
        ends = ends.unionAll(t.select("chain_id"))
    long = ends.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("chain_id")
    if long.isEmpty():
        return tables, None
    long = broadcast_if_small(long)
    return [t.join(long, "chain_id", "left_anti") for t in tables], [t.join(long, "chain_id", "left_semi") for t in tables]


def pack(nodes: DataFrame | None, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """chain_id, nodes, edges (a, b), starts: one row a chain."""
    of = lambda kind, what: F.collect_list(F.when(F.col("kind") == kind, what))
    return _rows(nodes, edges, starts).groupBy("chain_id").agg(
        of(0, F.col("a")).alias("nodes"), of(1, F.struct("a", "b")).alias("edges"), of(2, F.col("a")).alias("starts"))


class Graphs:
    """The graphs of a batch as one: vertices in the order of (chain, node), edges without repetition in CSR form."""

    def __init__(self, batch: pa.RecordBatch):
        nodes, edges, starts = (batch.column(i) for i in (1, 2, 3))
        place = lambda col: np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
        number = lambda flat: flat.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = edges.flatten()
        a, b = number(ends.field(0)), number(ends.field(1))
        at, edge_at, start_at = place(nodes), place(edges), place(starts)
        chain = np.concatenate([at, edge_at, edge_at, start_at])
        name = np.concatenate([number(nodes.flatten()), a, b, number(starts.flatten())])
        order = np.lexsort((name, chain))
        new = np.concatenate([[True], (np.diff(chain[order]) != 0) | (np.diff(name[order]) != 0)]) if len(order) else np.zeros(0, bool)
        vertex = np.empty(len(order), np.int64)
        vertex[order] = np.cumsum(new) - 1
        self.chain, self.name = chain[order][new], name[order][new]
        self.size, self.chains = len(self.chain), batch.num_rows
        self.is_node = np.zeros(self.size, bool)
        self.is_node[vertex[: len(at)]] = True
        m = len(a)
        pair = np.unique(vertex[len(at): len(at) + m] * max(1, self.size) + vertex[len(at) + m: len(at) + 2 * m])
        self.src, self.dst = pair // max(1, self.size), pair % max(1, self.size)
        self.starts = np.unique(vertex[len(at) + 2 * m:])

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges both ways, sorted and without repetition."""
        pair = np.unique(np.concatenate([self.src * max(1, self.size) + self.dst, self.dst * max(1, self.size) + self.src]))
        return pair // max(1, self.size), pair % max(1, self.size)


def _pointers(src: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=size))])


def _out(pointers: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``of`` each of their out-edges leaves, and the edges' places."""
    n = pointers[of + 1] - pointers[of]
    which = np.repeat(np.arange(len(of)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pointers[of], n)


def distances(g: Graphs, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Steps from the nearest start; -1: not reached.  Edges sorted by src."""
    far = np.full(g.size, -1, np.int64)
    pointers, front, level = _pointers(src, g.size), g.starts, 0
    while len(front):
        far[front] = level
        _, at = _out(pointers, front)
        front = np.unique(dst[at])
        front, level = front[far[front] < 0], level + 1
    return far


def peel(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Per chain the longest path, and whether peeling left nothing over."""
    depth, waits = np.zeros(g.size, np.int64), np.bincount(g.dst, minlength=g.size)
    pointers, front = _pointers(g.src, g.size), np.flatnonzero(waits == 0)
    while len(front):
        which, at = _out(pointers, front)
        to = g.dst[at]
        np.maximum.at(depth, to, depth[front[which]] + 1)
        np.subtract.at(waits, to, 1)
        front = np.unique(to)
        front = front[waits[front] == 0]
    longest = np.zeros(g.chains, np.int64)
    np.maximum.at(longest, g.chain, depth)
    return longest, np.bincount(g.chain[waits > 0], minlength=g.chains) == 0


def betweenness(g: Graphs) -> np.ndarray:
    """Sum over sources s and targets t other than v of the share of shortest paths from s to t that pass v."""
    pointers = _pointers(g.src, g.size)
    first = np.searchsorted(g.chain, np.arange(g.chains))
    width = np.bincount(g.chain, minlength=g.chains)
    out, sources = np.zeros(g.size), np.flatnonzero(g.is_node)
    cost = np.cumsum(width[g.chain[sources]])
    lo = 0
    while lo < len(sources):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, "right")))
        s = sources[lo:hi]
        lo = hi
        w = width[g.chain[s]]
        base = np.cumsum(w) - w - first[g.chain[s]]  # the place of the pair (k, v) is base[k] + v
        total = int(w.sum())
        far, paths = np.full(total, -1, np.int64), np.zeros(total)
        far[base + s], paths[base + s] = 0, 1.0
        k, v, level, hops = np.arange(len(s)), s, 0, []
        while len(k):
            which, at = _out(pointers, v)
            k_to, to = k[which], g.dst[at]
            a, b = base[k_to] + v[which], base[k_to] + to
            level += 1
            far[b[far[b] < 0]] = level
            new = far[b] == level
            a, b, k_to, to = a[new], b[new], k_to[new], to[new]
            np.add.at(paths, b, paths[a])
            hops.append((a, b))
            b, at = np.unique(b, return_index=True)
            k, v = k_to[at], to[at]
        share = np.zeros(total)
        for a, b in reversed(hops):
            np.add.at(share, a, paths[a] / paths[b] * (1 + share[b]))
        share[base + s] = 0.0
        out += np.bincount(np.repeat(first[g.chain[s]] - (np.cumsum(w) - w), w) + np.arange(total), weights=share, minlength=g.size)
    return out


def clustering(g: Graphs) -> np.ndarray:
    """2 * triangles / (d * (d - 1)) of the undirected graph without self-loops; 0 where d < 2."""
    low, high = np.minimum(g.src, g.dst), np.maximum(g.src, g.dst)
    keys = np.unique((low * g.size + high)[low != high])
    a, b = keys // max(1, g.size), keys % max(1, g.size)
    degree = np.bincount(a, minlength=g.size) + np.bincount(b, minlength=g.size)
    turn = (degree[a] > degree[b]) | ((degree[a] == degree[b]) & (a > b))
    u, w = np.where(turn, b, a), np.where(turn, a, b)
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    ends = _pointers(u, g.size)[u + 1]
    later = ends - np.arange(len(u)) - 1  # edges of the same end that follow: each makes a wedge
    found, lo, cost = np.zeros(g.size, np.int64), 0, np.cumsum(later)
    while lo < len(u):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, "right")))
        n = later[lo:hi]
        one = np.repeat(np.arange(lo, hi), n)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        x, y = np.minimum(w[one], w[two]), np.maximum(w[one], w[two])
        key = x * g.size + y
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        for corner in (u[one][hit], x[hit], y[hit]):
            found += np.bincount(corner, minlength=g.size)
        lo = hi
    return np.where(degree < 2, 0.0, 2.0 * found / np.maximum(degree * (degree - 1), 1))


def _per_node(g: Graphs, root: int) -> dict[str, Callable[[], np.ndarray]]:
    def from_root() -> np.ndarray:
        g.starts = np.flatnonzero(g.is_node & (g.name == root))
        return distances(g, g.src, g.dst)

    def between() -> np.ndarray:
        n = np.bincount(g.chain[g.is_node], minlength=g.chains)[g.chain].astype(float)
        return np.where(n > 2, betweenness(g) / np.maximum((n - 1) * (n - 2), 1), 0.0)

    return {"in_deg": lambda: np.bincount(g.dst, minlength=g.size), "out_deg": lambda: np.bincount(g.src, minlength=g.size),
            "clustering": lambda: clustering(g), "path_length": from_root, "betweenness": between, "max_depth": lambda: _depths(g)[0][g.chain]}


def _depths(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Per chain the longest path (nodes less one where there is a cycle), and whether there is none."""
    longest, acyclic = peel(g)
    n = np.bincount(g.chain[g.is_node], minlength=g.chains)
    return np.where(acyclic, longest, np.maximum(n - 1, 0)), acyclic


KINDS = {"in_deg": "long", "out_deg": "long", "clustering": "double", "path_length": "long", "betweenness": "double", "max_depth": "long"}


def _run(packed: DataFrame, schema: str, body: Callable[[pa.RecordBatch, Graphs], list[pa.Array]]) -> DataFrame:
    kind = packed.schema["chain_id"].dataType.simpleString()
    names = ["chain_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(body(b, Graphs(b)), names)

    return packed.mapInArrow(run, f"chain_id {kind}, {schema}")


def node_measures(nodes: DataFrame, edges: DataFrame, measures: tuple[str, ...], root: int = 0) -> DataFrame:
    """chain_id, node and the named measures (KINDS) of every node, in one pass over the packed chains."""
    def body(b: pa.RecordBatch, g: Graphs) -> list[pa.Array]:
        of, at = _per_node(g, root), np.flatnonzero(g.is_node)
        return [b.column(0).take(pa.array(g.chain[at])), pa.array(g.name[at]), *[pa.array(of[m]()[at]) for m in measures]]

    return _run(pack(nodes, edges), ", ".join(["node long", *[f"{m} {KINDS[m]}" for m in measures]]), body)


def chain_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """chain_id, is_dag, max_depth of every chain with nodes."""
    def body(b: pa.RecordBatch, g: Graphs) -> list[pa.Array]:
        longest, acyclic = _depths(g)
        has = np.flatnonzero(np.bincount(g.chain[g.is_node], minlength=g.chains))
        return [b.column(0).take(pa.array(has)), pa.array(acyclic[has]), pa.array(longest[has])]

    return _run(pack(nodes, edges), "is_dag boolean, max_depth long", body)


def reached(edges: DataFrame, starts: DataFrame, both_ways: bool = False) -> DataFrame:
    """chain_id, node, dist of every node that the starts reach (dist 0: a start)."""
    def body(b: pa.RecordBatch, g: Graphs) -> list[pa.Array]:
        far = distances(g, *(g.turned() if both_ways else (g.src, g.dst)))
        at = np.flatnonzero(far >= 0)
        return [b.column(0).take(pa.array(g.chain[at])), pa.array(g.name[at]), pa.array(far[at])]

    return _run(pack(None, edges, starts), "node long, dist long", body)
