"""Fingerprints, mixing and quality rules (DataFrame functions only)."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF001, edge_rows, frame, rows_of, sentence, words
from tracewise.llm import mixing, rules, sketch
from tracewise.llm.common import documents
from tracewise.llm.queries import QUERIES


def shingle_set(t):
    w = words(t)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(id, text, edited text, next text) of each row in order of descending id, nulls last, ties by text."""
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for k, (d, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t) // 3
        out.append((d, t, t[:len(t) - n] + nxt[:n], nxt))
    return out


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_every_row_meets_its_next(spark, edge, clashing, per_range, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(sketch.with_next, "__defaults__", ("doc_id", ("text",), per_range))
    want = sorted(((d or -1, t, e) for d, t, e, _ in edited(edge_rows())), key=str)
    for df in (edge, clashing):
        got = rows_of(sketch.fingerprints_with_edits(df))
        assert sorted(((r["doc_id"] or -1, r["text"], r["edited"]) for r in got), key=str) == want


def test_likeness_is_close(spark):
    rows = edited([(r["doc_id"], r["text"]) for r in rows_of(documents(spark, SF001))])
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op5_fingerprints"](spark, SF001))}
    off = []
    for d, t, e, nxt in rows:
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        off += [abs(r["near_edited"] - jaccard(shingle_set(t), shingle_set(e))), abs(r["near_next"] - jaccard(shingle_set(t), shingle_set(nxt)))]
        if len(shingle_set(t)) < sketch.K:
            assert r["n_shingles_estimate"] == len(shingle_set(t))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03
    by_text = defaultdict(set)
    for d, t, _, _ in rows:
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_sketches_merge(spark):
    a, b = sentence(1, 400), sentence(2, 300)
    df = spark.createDataFrame([(1, a, b)], "id int, a string, b string").select(
        "id", sketch.bottom_k(F.col("a")).alias("a"), sketch.bottom_k(F.col("b")).alias("b"))
    both = df.withColumn("m", sketch.merge(F.col("a"), F.col("b")))
    r = both.select("m", sketch.distinct_shingles(F.col("m")).alias("n"), sketch.containment(F.col("a"), F.col("m")).alias("c")).first()
    whole = len(shingle_set(a) | shingle_set(b))
    assert r.m == sorted(set(r.m)) and len(r.m) == sketch.K and abs(r.n - whole) < 0.35 * whole and r.c > 0.7
    parts = df.select("id", F.col("a").alias("sketch")).union(df.select("id", F.col("b").alias("sketch")))
    assert sketch.merge_all(parts, "id").first().sketch == r.m


def test_empty_table(spark, empty):
    assert sketch.fingerprints_with_edits(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert rules.judge(empty).count() == 0


def brute_targets(sizes, budget=1.5, most=2.0, cycle=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check_mix(got, rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) <= 1e-9 * max(1, target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        if target[r["source"]] >= r["source_size"] > 0:
            assert r["copies"] >= 1  # complete epochs come first
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mix(spark, edge, clashing):
    for df in (edge, clashing):
        got = rows_of(mixing.mix_sources(df))
        assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(words(r[1]))) for r in edge_rows())
        check_mix(got, edge_rows())


def test_mix_of_the_documents_and_reruns(spark):
    docs = documents(spark, SF001)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = rows_of(mixing.mix_sources(docs))
    check_mix(got, rows)
    again = rows_of(mixing.mix_sources(docs.repartition(7)))
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("bins", [mixing.BINS, 3])
def test_mix_takes_what_a_plain_sort_by_key_takes(spark, monkeypatch, bins):
    """All documents of a source sorted by their exponential keys, and taken in that order until its words are there."""
    import math

    monkeypatch.setattr(mixing, "BINS", bins)
    docs = documents(spark, "/root/testdata/sf0.01")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.quality_weight(F.col("text")).alias("w"), u.alias("u")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    target, want = brute_targets(sizes), {}
    for s in sizes:
        epochs = int(target[s] / sizes[s] + 1e-12)
        rest, at = max(0.0, target[s] - epochs * sizes[s]), 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (-math.log(r.u) / r.w, r.doc_id)):
            want[r.doc_id] = epochs + (at + r.size / 2 <= rest and at < rest)
            at += r.size
    got = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_sources(docs))}
    assert got == want and len(set(want.values())) > 1


def test_heavier_documents_come_first(spark):
    clean, junk = "word " * 20, "#$% 12 " * 10
    rows = [(k, clean if k % 2 else junk, None, "a", 0) for k in range(2000)] + [(9999, "w " * 200000, None, "b", 0)]
    got = rows_of(mixing.mix_sources(frame(spark, rows), budget=0.05))
    share = Counter(r["doc_id"] % 2 for r in got if r["source"] == "a" and r["copies"])
    assert share[1] > share[0]


def base(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_base_statistics(spark, edge, clashing):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted((r[0] or -1, *base(r[1])) for r in edge_rows())
    for df in (edge, clashing):
        got = rows_of(rules.judge(df))
        assert sorted((r["doc_id"] or -1, *(r[c] for c in fields)) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    texts = ["a b a b a b a b", "a b c a b c", "x\nx\n\nx \nx", "a a a", "a a a a", "", "one two", "l\r\nl\r\n\x0b\n\x0b"]
    got = {r["doc_id"]: r for r in rows_of(rules.judge(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])))}
    assert [tuple(got[k][c] for c in fields) for k in range(len(texts))] == [base(t) for t in texts]


def brute_posterior(votes):
    """EM in plain Python over single rows, for so many rounds that nothing moves any more."""
    import math

    good, bad, prior = dict.fromkeys(rules.RULES, rules.GOOD_RIGHT), dict.fromkeys(rules.RULES, rules.BAD_RIGHT), rules.PRIOR

    def one(v):
        odds = math.log(prior / (1 - prior))
        for r in rules.RULES:
            if v[r] == 1:
                odds += max(0.0, math.log(good[r] / (1 - bad[r])))
            elif v[r] == -1:
                odds += min(0.0, math.log((1 - good[r]) / bad[r]))
        return 1 / (1 + math.exp(-odds))

    moved = 1.0
    while moved > 1e-12:
        p = [one(v) for v in votes]
        held = max(1.0, rules.STRENGTH * len(votes))
        g, b = {}, {}
        for r in rules.RULES:
            s = {(x, y): sum((q if y else 1 - q) for v, q in zip(votes, p) if v[r] == x) for x in (1, -1) for y in (0, 1)}
            g[r] = (s[1, 1] + held * rules.GOOD_RIGHT) / (s[1, 1] + s[-1, 1] + held)
            b[r] = (s[-1, 0] + held * rules.BAD_RIGHT) / (s[-1, 0] + s[1, 0] + held)
        old = rules._weights(good, bad, prior)
        good, bad, prior = g, b, (sum(p) + held * rules.PRIOR) / (len(votes) + held)
        new = rules._weights(good, bad, prior)
        moved = max(abs(new[k] - old[k]) for k in new)
    return [one(v) for v in votes]


def test_posterior_is_that_of_em(spark):
    got = rows_of(rules.judge(documents(spark, SF001)))
    for r, p in zip(got, brute_posterior(got)):
        assert abs(r["quality"] - p) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = QUERIES["op10_quality_rules"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = judged.join(labels, "doc_id").filter("not base_failed").select("quality", "kept", "label").collect()
    right = sum(r.kept == (r.label == 1) for r in rows)
    assert right >= 0.98 * len(rows)
    assert judged.filter("not base_failed and not kept").count() < 0.1 * judged.count()


def test_queries_return_all_documents(spark):
    n = documents(spark, SF001).count()
    for q in ("op5_fingerprints", "op9_mixing", "op10_quality_rules"):
        assert QUERIES[q](spark, SF001).select("doc_id").distinct().count() == n
