"""Near-duplicates, substring dedup and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SF001, edge_rows, frame, rows_of, sentence, words
from tracewise.llm import blocks, minhash, substring, suffix
from tracewise.llm.components import components
from tracewise.llm.queries import QUERIES


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, percent=85):
    """Per row (doc_id, text): the smallest id of its class, linking all pairs of rows with an id."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                if rows[x][0] < rows[y][0]:
                    x, y = y, x
                parent[x] = y
    return [rows[root(i)][0] for i in range(len(rows))]


def check_classes(df, rows):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in rows_of(df))
    want = sorted((d or -1, len(shingle_set(t)), c or -1, d is None or c == d) for (d, t), c in zip(rows, brute_classes(rows)))
    assert got == want


def test_classes_of_edge_rows(spark, edge, clashing):
    rows = [(r[0], r[1]) for r in edge_rows()]
    check_classes(minhash.near_duplicates(edge), rows)
    check_classes(minhash.near_duplicates(clashing), rows)


def test_classes_of_an_empty_table(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_hot_group_of_near_copies(spark):
    """Many different near copies in one bucket, chains of edits, and unlike texts that share half: classes are exact."""
    random.seed(4)
    base = sentence(1, 120).split()
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = f"edit{random.randrange(10 ** 6)}"
        rows.append((1000 - k, " ".join(w)))
    drift = sentence(2, 100).split()
    for k in range(40):
        drift[k * 2] = f"step{k}"
        rows.append((2000 + k, " ".join(drift)))
    half = sentence(3, 60)
    rows += [(3000 + k, half + " " + sentence(100 + k, 50)) for k in range(60)]
    rows += [(4000 + k, half + " " + sentence(500, 8)) for k in range(5)]
    df = frame(spark, [(d, t, None, None, None) for d, t in rows])
    check_classes(minhash.near_duplicates(df), rows)


def test_two_texts_of_one_id(spark):
    """Each text of a repeated id links as a document of its own: ids 0..19 hold two texts, with a near copy of each elsewhere."""
    rows = []
    for k in range(20):
        one, two = sentence(900 + k, 80), sentence(950 + k, 80)
        rows += [(k, one), (k, two), (100 + k, f"{one} end"), (200 + k, f"{two} end")]
    want = brute_classes(rows)
    assert want[2::4] == want[3::4] == list(range(20))
    check_classes(minhash.near_duplicates(frame(spark, [(d, t, None, None, None) for d, t in rows])), rows)


def test_crowded_buckets_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(blocks, "ASKING", 4)
    monkeypatch.setattr(blocks, "ANSWERING", 7)
    half = sentence(3, 60)
    rows = [(k, half + " " + sentence(100 + k // 3, 10 + k % 2)) for k in range(40)]
    check_classes(minhash.near_duplicates(frame(spark, [(d, t, None, None, None) for d, t in rows])), rows)


@pytest.mark.parametrize("percent", [80, 60])
def test_small_sets_link_at_lower_thresholds(spark, percent):
    """Pairs of n and n + 1 shingles that share n, of which those of 4 and of 5 are links at 80 and those of 2 at 60."""
    rows = []
    for k in range(60):
        text = sentence(700 + k, 6 + k % 6)
        rows += [(10 * k, text), (10 * k + 1, f"{text} end{k}")]
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(frame(spark, [(d, t, None, None, None) for d, t in rows]), percent=percent))}
    assert [got[d] for d, _ in rows] == brute_classes(rows, percent)
    assert sum(got[10 * k + 1] == 10 * k for k in range(60)) == sum(100 * (2 + k % 6) >= percent * (3 + k % 6) for k in range(60))


def test_bands_and_least_set_follow_the_threshold():
    assert [minhash.least_set(p) for p in (85, 80, 60, 50)] == [6, 4, 2, 1]
    assert minhash.banding(85) == (42, 6) and minhash.banding(80) == (51, 5)
    assert all((1 - (p / 100) ** r) ** b <= minhash.MISS for p in range(20, 100) for b, r in [minhash.banding(p)])


def test_registers_keep_the_least_and_estimate_is_close():
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 2 ** 63, 1700, dtype=np.uint64), rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    common, own = common * np.uint64(2) + np.uint64(1), own * np.uint64(2)
    sets = [np.sort(np.concatenate([common, own[:150]])), np.sort(np.concatenate([common, own[150:]]))]
    reg = [minhash.registers(np.zeros(len(s), np.int64), s, 1) for s in sets]
    like, used = minhash.estimate(reg[0], reg[1], np.array([1850]), np.array([1850]))
    assert abs(like[0] - 1700 / 2000) < 0.12 and used[0] == minhash.REGISTERS
    assert (minhash.filled(minhash.registers(np.zeros(6, np.int64), sets[0][:6], 1)) > 0).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in rows_of(components(links))}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def brute_windows(rows, size):
    texts = [words(t) for t in rows]
    count = Counter(tuple(w[p:p + size]) for w in texts for p in range(len(w) - size + 1))
    out = []
    for w in texts:
        gone = {p + k for p in range(len(w) - size + 1) if count[tuple(w[p:p + size])] > 1 for k in range(size)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size", [35, 12])
def test_repeated_windows(spark, edge, clashing, size):
    rows = edge_rows()
    want = sorted(((r[0] or -1, *b) for r, b in zip(rows, brute_windows([r[1] for r in rows], size))), key=str)
    for df in (edge, clashing):
        got = rows_of(substring.remove_repeated_windows(df, window=size))
        assert sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_windows_of_periodic_and_random_texts(spark):
    random.seed(8)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(60)] + ["a " * 200, "a b " * 100]
    df = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(substring.remove_repeated_windows(df, window=9, gram=3))}
    assert [got[k] for k in range(len(texts))] == brute_windows(texts, 9)


def test_layout_is_kept(spark):
    passage = sentence(7, 36)
    rows = [(1, f"one\n\n{passage}\n  two three\n", None, None, None), (2, f"four {passage}", None, None, None), (3, "as  it\tis\n", None, None, None)]
    got = {r["doc_id"]: r["kept_text"] for r in rows_of(substring.remove_repeated_windows(frame(spark, rows), keep_layout=True))}
    assert got == {1: "one\n\ntwo three\n", 2: "four ", 3: "as  it\tis\n"}


def test_suffix_array_is_right():
    random.seed(1)
    for _ in range(3000):
        s = [random.randint(0, random.choice([1, 2, 4])) for _ in range(random.randint(0, 40))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix.suffix_array([]) == []


def brute_bytes(rows, size=suffix.LENGTH):
    texts = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: (d is None, d or 0)
    first: dict = {}
    for d, b in texts:
        for p in range(len(b) - size + 1):
            x = b[p:p + size]
            first[x] = min(first.get(x, key(d)), key(d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < key(d):
                gone[p:p + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d or -1, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows_of(df))


def test_seen_bytes(spark, edge, clashing):
    want = brute_bytes([(r[0], r[1]) for r in edge_rows()])
    assert digest(suffix.remove_seen_bytes(edge)) == want
    assert digest(suffix.remove_seen_bytes(clashing)) == want


def test_seen_bytes_of_overlapping_random_texts(spark):
    random.seed(12)
    pool = [sentence(k, 14) for k in range(6)]
    rows = [(k * 3 % 101, " ".join(random.choice(pool)[random.randint(0, 30):][: random.randint(20, 90)] for _ in range(random.randint(0, 8)))) for k in range(80)]
    rows += [(200, "ab" * 120), (201, "ab" * 60), (202, "a" * 300)]
    df = frame(spark, [(d, t, None, None, None) for d, t in rows])
    assert digest(suffix.remove_seen_bytes(df)) == brute_bytes(rows)


def test_empty_tables(empty):
    assert substring.remove_repeated_windows(empty).count() == 0
    assert suffix.remove_seen_bytes(empty).count() == 0


def test_queries_match_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text"))]
    check_classes(QUERIES["op1_minhash_dedup"](spark, SF001), docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(QUERIES["op4_substring_dedup"](spark, SF001))}
    assert got == {d: (n, g, sha(k)) for (d, _), (n, g, k) in zip(docs, brute_windows([t for _, t in docs], 35))}
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(QUERIES["op6_suffix_dedup"](spark, SF001)))
    assert got == brute_bytes([(d or None, t) for d, t in docs if d is not None]) or got == sorted((d if d != -1 else 0, *x) for d, *x in brute_bytes(docs))
