"""The similarity join against brute force, with the second search and small blocks forced."""

import random

import numpy as np
import pytest

from tests.llm.helpers import SF001, edge_rows, frame, rows_of, sentence
from tests.llm.test_dedup import brute_classes, shingle_set
from tracewise.llm import blocks
from tracewise.llm import jaccard_join as join
from tracewise.llm.common import documents
from tracewise.llm.queries import QUERIES


def check(df, rows, percent=80):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows_of(df))
    assert got == sorted((d or -1, len(shingle_set(t)), c or -1) for (d, t), c in zip(rows, brute_classes(rows, percent)))


def hot_rows():
    """A group of near copies, a drifting chain, texts that share most of a passage, and copies that are each too far from most others."""
    random.seed(4)
    base, rows = sentence(1, 120).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = f"edit{random.randrange(10 ** 6)}"
        rows.append((1000 - k, " ".join(w)))
    drift = sentence(2, 100).split()
    for k in range(30):
        drift[k * 3] = f"step{k}"
        rows.append((2000 + k, " ".join(drift)))
    passage = sentence(3, 60)
    rows += [(3000 + k, passage + " " + sentence(100 + k, 4 + k % 9)) for k in range(50)]
    far = sentence(5, 150).split()
    for k in range(40):
        w = list(far)
        for _ in range(random.randint(1, 5)):
            w[random.randrange(len(w))] = f"far{random.randrange(10 ** 6)}"
        rows.append((4000 + k, " ".join(w)))
    rows += [(5000 + k, sentence(700 + k % 7, 4 + k % 12)) for k in range(40)]
    return rows


def test_classes_of_edge_rows(edge, clashing, empty):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check(join.similarity_join(edge), rows)
    check(join.similarity_join(clashing), rows)
    assert join.similarity_join(empty).count() == 0


@pytest.mark.parametrize("small", [8, 2])
def test_hot_groups(spark, monkeypatch, small):
    """With ``small`` 2 nearly all signatures are crowded, so that many sets go through the second search."""
    monkeypatch.setattr(join, "SMALL", small)
    rows, seen = hot_rows(), []
    real = join._second_search
    monkeypatch.setattr(join, "_second_search", lambda *a: seen.append(a) or real(*a))
    df = frame(spark, [(d, t, None, None, None) for d, t in rows])
    check(join.similarity_join(df), rows)
    assert seen


def test_second_search_finds_what_the_first_drops(spark, monkeypatch):
    """The first search's candidates are thrown away: crowded signatures alone have to lead to every link."""
    monkeypatch.setattr(join, "SMALL", 1)
    monkeypatch.setattr(blocks, "ASKING", 7)
    monkeypatch.setattr(blocks, "ANSWERING", 5)
    real = join._stars
    monkeypatch.setattr(join, "_stars", lambda crowded, percent: real(crowded, percent).limit(0))
    rows = hot_rows()
    check(join.similarity_join(frame(spark, [(d, t, None, None, None) for d, t in rows])), rows)


def test_other_thresholds(spark):
    rows = hot_rows()[::2]
    df = frame(spark, [(d, t, None, None, None) for d, t in rows])
    for percent in (60, 90):
        check(join.similarity_join(df, percent), rows, percent)


def test_two_texts_of_one_id(spark):
    a, b = sentence(41, 80), sentence(42, 80)
    rows = [(5, a), (5, b), (3, b + " more"), (9, a), (9, a)]
    got = sorted((r["doc_id"], r["component_id"]) for r in rows_of(join.similarity_join(frame(spark, [(d, t, None, None, None) for d, t in rows]))))
    assert got == sorted([(5, 5), (5, 3), (3, 3), (9, 5), (9, 5)])


def test_partners_share_more_segments_than_they_may_differ_in():
    """Every pair of sizes that can link has a scheme with more segments than their difference, votes to spare included."""
    for percent in (60, 80, 90):
        schemes = join.Schemes(percent, 4000)
        sizes = np.arange(1, 2500)
        band = schemes.band(sizes)
        for s in sizes[::7].tolist():
            most = min(s * 100 // percent, 2499)
            assert band[most - 1] - band[s - 1] <= 1
            for partner in {s, (s + most) // 2, most}:
                apart = join.most_apart(s, partner, percent)
                both = s + partner
                assert all((100 * (both - d) // 2 >= percent * (both + d) / 2) == (d <= apart) for d in range(both % 2, min(both, apart + 6), 2) if d <= both)
                assert schemes.segments[band[s - 1]] > apart and schemes.apart(np.array([s]), False)[0] >= apart
                if band[partner - 1] != band[s - 1]:
                    assert schemes.apart(np.array([partner]), True)[0] >= apart


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(documents(spark, SF001).select("doc_id", "text"))]
    check(QUERIES["op13_ngram_join"](spark, SF001), rows)
