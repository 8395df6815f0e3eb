"""The Merkle manifest and the whitening against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF001, edge_rows, frame, rows_of
from tracewise.llm import merkle, whitening
from tracewise.llm.common import documents
from tracewise.llm.queries import QUERIES

# --- op11 -------------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, _, lang, source, n_chars = row
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels(nodes, fanout=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i: i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout=8):
    for level in tree[:-1]:
        run = level[i // fanout * fanout: i // fanout * fanout + fanout]
        yield run[: i % fanout], run[i % fanout + 1:]
        i //= fanout


def brute(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for of in groups.values():
        of.sort(key=lambda r: (r[0] is not None, r[0], leaf(r, r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r, r[1]) for r in groups[g]], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*siblings(trees[g], i, fanout), *siblings(top, k, fanout)]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r, text)
            for before, after in steps:
                folded = h("".join(before) + folded + "".join(after))
            proof = h("".join("".join(b) + "".join(a) for b, a in steps))
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def check(df, rows):
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows_of(df)]
    assert sorted(got, key=str) == brute(rows)


def test_manifest_of_edge_rows(edge, clashing, empty):
    check(merkle.verify(edge), edge_rows())
    check(merkle.verify(clashing), edge_rows())
    assert merkle.verify(empty).count() == 0 and merkle.build(empty).root is None


@pytest.mark.parametrize("langs, n", [(("en",), 1), (("en",), 9), ((None, "de"), 3), (tuple(f"l{k:02}" for k in range(11)), 30), (("en", "fr"), 150)])
def test_trees_of_many_shapes(spark, langs, n):
    """A lone leaf, a lone tree, more trees than a run holds, runs of one node; ties of ids and repeated rows."""
    rows = [(k // 2 if k % 9 == 0 else k, f"Text {k % 7} of A", langs[k * k % len(langs)], None if k % 5 else "s", k % 4) for k in range(n)]
    rows += rows[: n // 10]
    check(merkle.verify(frame(spark, rows)), rows)


def test_only_the_tampered_leaf_fails(spark):
    docs = documents(spark, SF001)
    m = merkle.build(docs, carry={"now": F.when(F.col("doc_id") == 77, F.unhex(F.sha2(F.lit("other"), 256))).otherwise(
        merkle.leaf_of([F.col(c) for c in merkle.COLUMNS]))})
    bad = [r["id"] for r in merkle.climb(m, "now").collect() if bytes(r["folded"]).hex() != m.root]
    assert bad == [77]


def test_other_fanout_and_the_session(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    docs = documents(spark, SF001)
    m = merkle.build(docs, fanout=3)
    got = merkle.climb(m).collect()
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows_of(docs)]
    assert {x[3] for x in brute(rows, 3)} == {m.root} and all(bytes(r["folded"]).hex() == m.root for r in got) and len(got) == len(rows)
    assert spark.conf.get(key) == before


# --- op12 -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(ids, vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {i: int(((n * v - s) ** 2).sum()) for i, v in zip(ids, x)}, e, y @ u, e / np.trace(y.T @ y / n)


def compare(df, ids, vectors):
    got = df.toPandas()
    deviation, e, projected, explained = plain(ids, vectors)
    width = len(e)
    assert len(got) == len(ids) * width and set(got.n) == {len(ids)}
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    live = e > 1e-12 * e.sum()
    want = projected[:, live] / np.sqrt(e[live])
    table_live = table[:, live]
    sign = np.sign((table_live * want).sum(axis=0))
    assert np.abs(table_live * sign - want).max() < 1e-7 and np.isnan(table[:, ~live].astype(float)).all()
    assert np.abs(got.drop_duplicates("component").sort_values("component").explained.to_numpy() - explained).max() < 1e-9
    assert got.identity_error.max() < 1e-9


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    compare(QUERIES["op12_embedding_whitening"](spark, SF001), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_vectors_that_are_left_out(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=40).astype(np.float32).tolist(), 0) for k in range(150)]
    bad = [(900, None, 1), (901, [1.0] * 39 + [None], 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] + [0.0] * 39, 1), (904, [], 1), (905, [1.0, 2.0], 1), (None, good[3][1], 1)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumn("x", F.lit("clash")).withColumn("whitened", F.lit("clash"))
    out = whitening.whitened(df)
    assert {r.vec_id for r in out.select("vec_id").distinct().collect()} == {k for k, _, _ in good} | {None}
    compare(whitening.whitened(df.filter("vec_id is not null")), [k for k, _, _ in good], [v for _, v, _ in good])
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.filter("vec_id = 902")).count() == 0


@pytest.mark.parametrize("rows", [1, 5, 20])
def test_fewer_vectors_than_dimensions(spark, rows):
    """Components without variance are null; equal vectors have none at all."""
    rng = np.random.default_rng(rows)
    vectors = [rng.normal(size=12).astype(np.float32).tolist() for _ in range(rows)]
    if rows > 1:
        compare(whitening.whitened(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], VECTORS)), list(range(rows)), vectors)
    same = whitening.whitened(spark.createDataFrame([(k, vectors[0], 0) for k in range(rows)], VECTORS)).collect()
    assert len(same) == rows * 12 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)


def test_rank_one_updates_and_combination():
    """Scatter of vectors with ties, repeats, very different scales and constant entries, taken in one after another and in parts."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 24)) * 10.0 ** rng.uniform(-1, 3, 24)).astype(np.int64) + whitening.SHIFT
    x[50:90] = x[49]
    x[:, 7] = 12
    x[:, 8] = x[:, 9]
    want = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    whole = whitening.take(whitening.empty(24), x)
    parts = [whitening.take(whitening.empty(24), x[a:b]) for a, b in ((0, 1), (1, 60), (60, 61), (61, 400))]
    joined = parts[0]
    for p in parts[1:]:
        joined = whitening.combine(joined, p)
    for s in (whole, joined):
        assert s.n == 400 and (s.sums == x.sum(axis=0)).all()
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-9 * want.max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(24)).max() < 1e-10 and (np.diff(s.values) >= -1e-6 * s.values.max()).all()


def test_secular_roots():
    rng = np.random.default_rng(6)
    for k in (1, 2, 5, 40):
        for scale in (1e-6, 1.0, 1e6):
            d, w = np.sort(rng.uniform(0, 1, k)).cumsum(), rng.normal(size=k) * scale
            roots, gap = whitening.secular_roots(d, w)
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(w, w))
            assert np.abs(roots - want).max() <= 1e-12 * max(1, want.max())
            assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and np.abs(gap - (d - roots[:, None])).max() <= 1e-9 * max(1, want.max())


def test_spectra_are_combined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROUND", 2)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(90, 6)).astype(np.float32).tolist()
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], VECTORS).repartition(11)
    compare(whitening.whitened(df), list(range(90)), vectors)
