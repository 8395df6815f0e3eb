"""The pipeline's stages against the operators' brute-force versions, and the entry's guard."""

import os
import subprocess
import sys
import textwrap
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import SF001, edge_rows, frame, rows_of, sentence, words
from tests.llm.test_dedup import brute_classes, brute_windows, shingle_set
from tracewise.llm.common import documents, materialise

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "tokenise"]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_every_stage_handles_edge_rows_and_empty_tables(spark, name, edge, clashing, empty):
    for df in (edge, clashing):
        out = stage(name)(spark, df, SF001)
        if name != "tokenise":
            assert out.columns == list(pipeline.COLUMNS)
        out.collect()
    assert stage(name)(spark, empty, SF001).count() == 0


def test_language_stage_rejects_texts_without_letters(spark, edge):
    kept = {r["doc_id"] for r in rows_of(pipeline.language_id(spark, edge, SF001))}
    assert not kept & {2, 3, 4} and {1, 5, 6, 9, 13} <= kept
    docs = documents(spark, SF001)
    assert pipeline.language_id(spark, docs, SF001).count() >= 0.99 * docs.count()


def one_of_each(rows, percent=85):
    """The rows (id, text) that stay: of each class the one of the smallest id, rows without an id last."""
    kept = []
    names = brute_classes(list(enumerate(t for _, t in rows)), percent)
    for c in set(names):
        kept.append(min((rows[i] for i in range(len(rows)) if names[i] == c), key=lambda r: (r[0] is None, r[0] or 0)))
    return kept


def test_language_stage_rejects_unknown_languages(spark):
    """Texts whose letters are at random, or of scripts and languages that no document has, go; documents stay, every one."""
    import random

    random.seed(1)
    noise = " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9))) for _ in range(60))
    strange = ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
               "Zażółć gęślą jaźń. W Szczebrzeszynie chrząszcz brzmi w trzcinie", noise]
    docs = documents(spark, "/root/testdata/sf0.01").select(*pipeline.COLUMNS)
    planted = frame(spark, [(-1 - k, t, None, "x", len(t)) for k, t in enumerate(strange)])
    kept = {r["doc_id"] for r in rows_of(pipeline.language_id(spark, docs.unionByName(planted), SF001).select("doc_id"))}
    assert kept == {r["doc_id"] for r in rows_of(docs.select("doc_id"))}


def test_near_dedup_keeps_one_of_each_class(spark, edge):
    rows = sorted({(r[0], r[1]) for r in edge_rows()}, key=str)
    got = Counter((r["doc_id"], r["text"]) for r in rows_of(pipeline.near_dedup(spark, edge, SF001)))
    assert got == Counter(one_of_each(rows))
    docs = documents(spark, SF001)
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs.select("doc_id", "text"))]
    assert sorted(r["doc_id"] for r in rows_of(pipeline.near_dedup(spark, docs, SF001))) == sorted({c for c in brute_classes(rows)})


def test_near_dedup_judges_rows_not_ids(spark):
    """Two texts of one id, copies under other ids and without one."""
    a, b = sentence(51, 60), sentence(52, 60)
    rows = [(5, a), (5, b), (3, b), (None, a), (None, a), (None, sentence(53, 60)), (7, sentence(54, 60)), (7, sentence(54, 60))]
    got = sorted(((r["doc_id"], r["text"]) for r in rows_of(stage("near_dedup")(spark, frame(spark, [(d, t, "en", "a", 1) for d, t in rows]), SF001))), key=str)
    assert got == sorted([(5, a), (3, b), (None, sentence(53, 60)), (7, sentence(54, 60))], key=str)


def test_near_dedup_links_from_80_percent(spark):
    base = sentence(31, 104).split()
    edited = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, edited(30, 60)), (3, edited(15, 35, 55, 75, 95))]
    sets = [shingle_set(t) for _, t in rows]
    assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and brute_classes(rows, 80) == [1, 1, 3]
    got = rows_of(stage("near_dedup")(spark, frame(spark, [(d, t, "en", "a", len(t)) for d, t in rows]), SF001))
    assert sorted(r["doc_id"] for r in got) == [1, 3]
    docs = documents(spark, SF001)
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs.select("doc_id", "text"))]
    assert sorted(r["doc_id"] for r in rows_of(stage("near_dedup")(spark, docs, SF001))) == sorted(set(brute_classes(rows, 80)))


def test_substring_stage_rewrites_texts(spark):
    passage = sentence(7, 60)
    rows = [(1, f"one\n{passage}\ntwo", "en", "a", 0), (2, passage, "en", "a", 0), (3, "left as\n\nit is ", "en", "b", 0)]
    got = {r["doc_id"]: r for r in rows_of(pipeline.substring_dedup(spark, frame(spark, rows), SF001))}
    assert set(got) == {1, 3} and got[1]["text"] == "one\ntwo" and got[3]["text"] == "left as\n\nit is " and got[1]["n_chars"] == 7
    docs = documents(spark, SF001)
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs.select("doc_id", "text"))]
    want = {d: k.split() for (d, _), (n, g, k) in zip(rows, brute_windows([t for _, t in rows], 35)) if g < n or not g}
    got = {r["doc_id"]: words(r["text"]) for r in rows_of(pipeline.substring_dedup(spark, docs, SF001))}
    assert got == want


def test_mixing_stage_repeats_rows(spark):
    got = Counter(r["doc_id"] for r in rows_of(pipeline.mix(spark, documents(spark, SF001), SF001)))
    from tracewise.llm import mixing

    want = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_sources(documents(spark, SF001))) if r["copies"]}
    assert got == want


def test_mixing_stage_counts_rows_that_share_an_id(spark):
    """Rows of one id or of none, in sources of different targets: each source gets the words that the operator takes."""
    rows = [(d, sentence(k, 5 + k % 9), "en", "abc"[k % 3], k) for k in range(120) for d in [None if k % 2 else k // 6]]
    df = frame(spark, rows)
    from tracewise.llm import mixing

    want = Counter()
    for r in rows_of(mixing.mix_sources(df)):
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in rows_of(pipeline.mix(spark, df, SF001)):
        got[r["source"]] += len(words(r["text"]))
    assert got == want


def test_run_equals_the_stages_one_by_one(spark):
    docs = documents(spark, SF001)
    for name, f in pipeline.STAGES:
        docs = materialise(f(spark, docs, SF001), name)
    key = lambda df: sorted((r["doc_id"], r["n_chars"], tuple(r["ids"])) for r in rows_of(df))
    assert key(pipeline.run(spark, SF001)) == key(docs)


def test_entry_works_without_this_subpackage():
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith("tracewise.llm") or name == "corpus_pipeline":
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
        assert set(e.oracle_sql()) <= set(e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry_has_all_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14)) and "pipeline" in names
