"""Graph measures on arrays and by joins against plain Python, on random graphs with cycles, self-loops and repeated edges."""

import random
from collections import deque
from itertools import combinations

import pytest

from tracewise.operators import chain_arrays, graph, propagate, validate
from tracewise.operators.stars import components

ORDER = ("in_deg", "out_deg", "clustering", "path_length", "betweenness", "max_depth")


def hops(out, start):
    far, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for w in out[v]:
            if w not in far:
                far[w] = far[v] + 1
                todo.append(w)
    return far


def brute(nodes, edges):
    """(in_deg, out_deg, clustering, path_length, betweenness, max_depth) of each node, and whether the graph is acyclic."""
    edges = set(edges)
    out = {v: sorted(b for a, b in edges if a == v) for v in nodes}
    near = {v: {b for a, b in edges if a == v and b != v} | {a for a, b in edges if b == v and a != v} for v in nodes}
    far = {v: hops(out, v) for v in nodes}

    def paths(s, t):
        if t not in far[s]:
            return 0
        return 1 if s == t else sum(paths(s, u) for u in nodes if t in out[u] and far[s].get(u, -2) == far[s][t] - 1)

    n, acyclic = len(nodes), all(v not in {x for w in out[v] for x in far[w]} for v in nodes)
    if acyclic:
        depth = {}
        walk = lambda v: depth.setdefault(v, max([1 + walk(w) for w in out[v]], default=0))
        longest = max(map(walk, nodes))
    else:
        longest = n - 1
    rows = {}
    for v in nodes:
        d = len(near[v])
        triangles = sum(b in near[a] for a, b in combinations(near[v], 2))
        between = sum(paths(s, v) * paths(v, t) / paths(s, t) for s in nodes for t in nodes
                      if v not in (s, t) and s != t and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t])
        rows[v] = (sum(b == v for _, b in edges), len(out[v]), 2 * triangles / (d * (d - 1)) if d > 1 else 0.0, far[0].get(v, -1) if 0 in far else -1,
                   between / ((n - 1) * (n - 2)) if n > 2 else 0.0, longest)
    return rows, acyclic


@pytest.fixture(scope="module")
def chains():
    random.seed(8)
    out = {}
    for k in range(24):
        n = random.randint(1, 9)
        nodes = list(range(n)) if k % 5 else [v + 1 for v in range(n)]  # some have no node 0
        pick = (lambda: (random.choice(nodes), random.choice(nodes))) if k % 3 else (lambda: tuple(sorted((random.choice(nodes), random.choice(nodes)))))
        edges = [pick() for _ in range(random.randint(0, 2 * n))]
        if k % 3 == 0:
            edges = [e for e in edges if e[0] != e[1]]
        out[f"c{k}"] = (nodes, edges + edges[:2])
    return out


@pytest.fixture(scope="module")
def tables(spark, chains):
    nodes = spark.createDataFrame([(c, v) for c, (ns, _) in chains.items() for v in ns], "chain_id string, node long")
    edges = spark.createDataFrame([(c, a, b) for c, (_, es) in chains.items() for a, b in es], "chain_id string, src long, dst long")
    return nodes.cache(), edges.cache()


@pytest.mark.parametrize("limit", [chain_arrays.ROW_ENDS, 12, 0])
def test_all_measures(chains, tables, limit):
    """``limit`` sends all chains, the longer ones or none through the arrays; the rest go through joins."""
    got = {(r["chain_id"], r["node"]): tuple(r[m] for m in ORDER) for r in graph.topology(*tables, ORDER, limit=limit).collect()}
    assert len(got) == sum(len(n) for n, _ in chains.values())
    for c, (nodes, edges) in chains.items():
        for v, want in brute(nodes, edges)[0].items():
            assert got[c, v] == pytest.approx(want, abs=1e-6), (c, v)
    depths = {r["chain_id"]: (r["is_dag"], r["max_depth"]) for r in graph.longest_paths(*tables, limit=limit).collect()}
    assert depths == {c: (brute(*g)[1], next(iter(brute(*g)[0].values()))[5]) for c, g in chains.items()}


@pytest.mark.parametrize("limit", [chain_arrays.ROW_ENDS, 0])
def test_distances_from_several_starts(spark, chains, tables, limit):
    starts = [(c, v) for c, (ns, _) in chains.items() for v in ns[::4]]
    got = {(r["chain_id"], r["node"]): r["dist"] for r in graph.distances(tables[1], spark.createDataFrame(starts, "chain_id string, node long"), limit).collect()}
    want = {}
    for c, (ns, es) in chains.items():
        out = {v: [b for a, b in es if a == v] for v in ns}
        for v in ns[::4]:
            for w, d in hops(out, v).items():
                want[c, w] = min(d, want.get((c, w), d))
    assert got == want


@pytest.mark.parametrize("limit", [chain_arrays.ROW_ENDS, 0])
def test_unreached_nodes(chains, tables, limit):
    got = {tuple(r) for r in validate.unreached_nodes(tables[0], tables[1], tables[0], limit).collect()}
    want = set()
    for c, (ns, es) in chains.items():
        both = {v: [b for a, b in es if a == v] + [a for a, b in es if b == v] for v in {0, *ns}}
        want |= {(c, v) for v in ns if v not in hops(both, 0)}
    assert got == want


def test_small_blocks_of_pairs_and_wedges(chains, tables, monkeypatch):
    """The same numbers when a block holds a single source or wedge."""
    import pyarrow as pa

    packed = chain_arrays.pack(*tables).toArrow().combine_chunks().to_batches()[0]
    g = chain_arrays.Graphs(packed)
    want = chain_arrays.betweenness(g), chain_arrays.clustering(g)
    monkeypatch.setattr(chain_arrays, "PAIRS", 3)
    assert chain_arrays.betweenness(g) == pytest.approx(want[0]) and (chain_arrays.clustering(g) == want[1]).all()
    assert isinstance(packed, pa.RecordBatch)


def test_a_long_path_is_labelled_in_few_rounds(spark):
    path = spark.range(10_000).selectExpr("'p' as chain_id", "id as src", "id + 1 as dst")
    ring = spark.range(50).selectExpr("'r' as chain_id", "id + 7 as src", "pmod(id + 1, 50) + 7 as dst")
    rounds = []
    got = components(path.unionByName(ring), lambda k, n: rounds.append((k, n)))
    assert got.selectExpr("chain_id", "component").distinct().collect() and {tuple(r) for r in got.select("chain_id", "component").distinct().collect()} == {("p", 0), ("r", 7)}
    assert got.count() == 10_001 + 50 and len(rounds) < 20


def test_empty_tables(spark, tables):
    nodes, edges = tables[0].limit(0), tables[1].limit(0)
    assert graph.topology(nodes, edges).count() == 0 and graph.longest_paths(nodes, edges).count() == 0
    alone = graph.topology(tables[0], edges, ("in_deg", "max_depth", "betweenness")).collect()
    assert len(alone) == tables[0].count() and all(tuple(r)[2:] == (0, 0, 0.0) for r in alone)


def test_propagation_uses_both_directions(spark):
    steps = spark.createDataFrame([("a", i, i < 2, i == 2) for i in range(5)], "chain_id string, idx long, is_correct boolean, is_origin boolean")
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(4)], "chain_id string, src long, dst long")
    summ = propagate.chain_summary(steps, edges, spark.createDataFrame([("a", 2)], "chain_id string, idx long"))
    assert sorted(tuple(r) for r in propagate.origin_distances(summ, edges).collect()) == [("a", 2, 0), ("a", 3, 1), ("a", 4, 2)]
    assert sorted(tuple(r) for r in propagate.intervention_points(summ, steps, edges).collect()) == [("a", 0), ("a", 1)]
