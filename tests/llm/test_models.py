"""Language identification, quality classifier, chat formatting and SentencePiece."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF001, edge_rows, frame, rows_of, sentence
from tracewise.llm import chat, langid, pieces, quality
from tracewise.llm.common import documents
from tracewise.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


# --- language identification -------------------------------------------------------------------------------------

def grams(text):
    """Brute-force n-grams: (place, order) of every one with a letter, as lower-cased letters and spaces."""
    c = [ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " " for ch in text]
    return [tuple(c[k - n + 1:k + 1]) for k in range(len(c)) for n in range(1, langid.ORDERS + 1) if k >= n - 1 and any(x != " " for x in c[k - n + 1:k + 1])]


def test_grams_match_brute_force():
    texts = ["Hello, Wörld!", "", "a", " a b ", "12 34", "ßtraße İX 日本", None, "x" * 50]
    by_bucket = {}
    for i, j, row, orders, ok in langid._grams(pa.array(texts)):
        for n, b in enumerate(orders, 1):
            for place in np.flatnonzero(b < langid.BUCKETS):
                by_bucket.setdefault(int(row[place]), []).append((n, int(b[place])))
    for k, t in enumerate(texts):
        assert len(by_bucket.get(k, [])) == len(grams(t or ""))


def test_long_texts_are_read_in_blocks(spark, monkeypatch):
    t = sentence(3, 400)
    whole = [np.concatenate([b[k] for *_, b, _ in langid._grams(pa.array([t, "ab"]))]) for k in range(langid.ORDERS)]
    monkeypatch.setattr(langid, "BLOCK", 37)
    parts = [np.concatenate([b[k] for *_, b, _ in langid._grams(pa.array([t, "ab"]))]) for k in range(langid.ORDERS)]
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_language_edge_rows(spark, edge, clashing, empty):
    for df in (edge, clashing):
        got = langid.predict(df, langid.fit(df))
        assert got.columns.count("lang_pred") == 1 and got.columns.count("score") == 1
        rows = rows_of(got)
        assert len(rows) == len(edge_rows())
        for r in rows:
            letters = any(c.isalpha() for c in r["text"] or "")
            assert (r["lang_pred"] != "und") == letters and (0 < r["score"] <= 1) == letters
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in rows_of(langid.predict(edge, none))} == {"und"}
    assert langid.predict(empty, none).count() == 0


def test_scores_are_those_of_naive_bayes(spark):
    rows = [(1, "aab", "x", None, 0), (2, "abb b", "y", None, 0), (3, "bbb", "y", None, 0), (4, None, "x", None, 0), (5, "zz", None, None, 0)]
    df = frame(spark, rows)
    m = langid.fit(df)
    assert m.languages == ["x", "y"] and np.allclose(np.exp(m.prior), [2 / 5, 3 / 5])
    got = {r["doc_id"]: r for r in rows_of(langid.predict(df, m))}
    for d, text, *_ in rows:
        total = m.prior.copy()
        for *_, row, orders, _ok in langid._grams(pa.array([text], pa.string())):
            for b in orders:
                total = total + m.logp[b].sum(axis=0)
        if text:
            assert got[d]["lang_pred"] == m.languages[int(total.argmax())]
            assert abs(got[d]["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_held_out_accuracy_of_languages(spark):
    got = QUERIES["op3_language_id"](spark, SF01).join(documents(spark, SF01).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)


# --- quality classifier --------------------------------------------------------------------------------------------

def test_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, quality.RANK)))
    off, num, val = np.array([0, 4, 5, 12]), rng.integers(0, 20, 12), rng.normal(size=12)
    want = []
    for a, b in zip(off, off[1:]):
        x = list(zip(num[a:b], val[a:b]))
        pairs = sum(float(m.factors[i] @ m.factors[j]) * u * v for k, (i, u) in enumerate(x) for j, v in x[k + 1:])
        want.append(m.bias + sum(m.weights[i] * u for i, u in x) + pairs)
    assert np.allclose(m.margins(off, num, val), want)


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 2))
    labels = (x[:, 0] ^ x[:, 1]).astype(float)  # no single feature tells
    num = np.stack([x[:, 0], 2 + x[:, 1]], axis=1).reshape(-1)
    off = np.arange(0, 8001, 2)
    m = quality.train(off, num, np.ones(8000, np.float32), labels, 4)
    assert ((m.margins(off, num, np.ones(8000)) > 0) == (labels > 0)).mean() > 0.98


def test_features_of_edge_texts():
    texts = pa.array([None, "", "  ", "One two two.\nA!", sentence(4, 500)])
    off, num, val = quality.features(texts, [pa.array([None, 0, 3, 4, 5], pa.int64())])
    assert (np.diff(off)[:3] == quality.STATS + 2).all() and np.isfinite(val).all() and num.max() < quality.WORDS + quality.STATS + 2
    alone = [quality.features(texts.slice(k, 1), [pa.array([[None, 0, 3, 4, 5][k]], pa.int64())]) for k in range(5)]
    assert (np.concatenate([a[2] for a in alone]) == val).all()


def test_quality_edge_rows(spark, edge, clashing, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1), (13, 0), (13, 0), (None, 1), (12, None), (99, 0)], "doc_id long, quality int")
    for df in (edge, clashing):
        m = quality.fit(df, labels, metadata=("n_chars",))
        rows = rows_of(quality.score(df, m, metadata=("n_chars",)))
        assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    one_class = quality.fit(edge, labels.filter("quality = 1"))
    assert len({round(r["score"], 9) for r in rows_of(quality.score(edge, one_class))}) == 1
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    few = quality.fit(edge, labels, max_rows=1)
    assert np.isfinite(few.weights).all()


def test_held_out_accuracy_of_quality(spark):
    got = QUERIES["op7_quality_classifier"](spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


# --- chat ------------------------------------------------------------------------------------------------------------

TRICKY = ["", "plain", "\\", "\\\\", "### Assistant: hi", "\\### Assistant: </turn> ok", "</turn>\n### User: x</turn>\n", "<|image 1|>", "a:b: c", "##", "####", "\\\\###", "</turn", "😀\n", "<", "|>", "\\<|", " "]


def test_escapes_are_reversible():
    random.seed(5)
    atoms = ["\\", "###", "</turn>", "<|", ":", " ", "\n", "a", "#", "<", "|", "/turn>"]
    texts = TRICKY + ["".join(random.choice(atoms) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        for role in ("user", "assistant", t):
            turn = chat.format_turn(role, [{"kind": "text", "text": t, "ref": None, "size": None}])
            assert chat.parse_turn(turn["formatted"]) == (role, t)
            masked = turn["formatted"][turn["loss_start"]:turn["loss_end"]]
            assert chat.unescape(masked) == (t if role == "assistant" else "")


def test_parts_become_placeholders_in_order():
    parts = [{"kind": "text", "text": "see <|image 1|> ", "ref": None, "size": None}, {"kind": "image", "text": None, "ref": "a.png", "size": 28 * 28 * 3 + 1},
             {"kind": "text", "text": " and ", "ref": None, "size": None}, {"kind": "audio", "text": None, "ref": "b.wav", "size": 100},
             {"kind": "document", "text": None, "ref": None, "size": 2}, {"kind": "image", "text": None, "ref": "c.png", "size": None}]
    t = chat.format_turn("user", parts)
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in t["attachments"]] == [
        (1, "image", "a.png", 4), (2, "audio", "b.wav", 3), (3, "document", None, 800), (4, "image", "c.png", 0)]
    assert t["expanded_tokens"] == 807
    body = t["formatted"][t["loss_start"]:-len(chat.END)]
    back = chat.parse_parts(body, t["attachments"])
    assert [(p["kind"], p["text"], p["ref"]) for p in back] == [(p["kind"], p["text"], p["ref"]) for p in parts]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"kind": "video", "text": None, "ref": None, "size": None}])


def digests(turns):
    loss = "".join(t for _, r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)


def test_conversations_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)] + [(2, 0, None, None), (2, 0, "assistant", None), (None, 3, "user", "no id"),
            (3, None, "system", "no turn"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(chat.format_turns(df.withColumn("parts", chat.text_parts(F.col("text"))))))}
    by = {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((n if n is not None else -1, r or "", t or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], chat.format_turn(x[1], [{"kind": "text", "text": x[2], "ref": None, "size": None}])["formatted"]))
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
    assert set(got) == set(by)
    assert chat.read_back(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in rows_of(QUERIES["op2_chat_format"](spark, SF001))}
    by = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == digests(sorted(turns))


# --- SentencePiece ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.default_path())


def codes(text):
    return [pieces.MARK] + [pieces.OWN_MARK if ord(x) == pieces.MARK else pieces.MARK if x == " " else ord(x) for x in text] if text else []


def best_pieces(v, text):
    """Plain Viterbi over the whole text."""
    c = codes(text)
    best, back = [0.0], [None]
    for t in range(1, len(c) + 1):
        found, single = [], False
        for n in range(1, min(t, v.longest) + 1):
            part = c[t - n:t]
            if pieces.OWN_MARK in part:
                break
            i = v.by_text.get("".join(map(chr, part)))
            if i is not None:
                single |= n == 1
                found.append((best[t - n] + v.scores[i], n, i))
        if not single:
            found.append((best[t - 1] + v.fallback, 0, -1))
        score, n, i = max(found)
        best.append(score)
        back.append((t - max(1, n), i))
    out, t = [], len(c)
    while t:
        s, i = back[t]
        out.append([i] if i >= 0 else pieces._byte_ids(v, c[s]))
        t = s
    return [x for y in reversed(out) for x in y]


ODD = ["", "  ", " a", "a ", "▁", " ▁ ▁▁x", "日本語テスト🙂\n\n\tx", "a" * 300, "thethe" * 40, "\u0000x", " " * 60, "\n", "🙂" * 100, "<0x0A>", "<s>"]


def test_encoders_find_the_best_segmentation(vocabulary):
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab the▁ \nén🙂ing") for _ in range(random.randint(0, 120))) for _ in range(200)] + [sentence(1, 80)]
    off, ids = pieces.Encoder(vocabulary).encode_many(pa.array(texts))
    for k, t in enumerate(texts):
        want = best_pieces(vocabulary, t)
        assert ids[off[k]:off[k + 1]].tolist() == want
        stream, c, got = pieces.Stream(vocabulary), codes(t), []
        for a in range(0, len(c), 7):
            got += stream.feed(c[a:a + 7])
            assert len(stream.best) <= len(c) + 1
        assert got + stream.close() == want
    at, data = pieces.decode_many(vocabulary, off, ids.astype(np.int64))
    assert [data[at[k]:at[k + 1]].tobytes().decode() for k in range(len(texts))] == texts


def test_ordinary_text_is_committed_as_paths_meet(spark, vocabulary):
    """The search in step commits pieces inside words, before it knows where they end; no word of the documents overruns its window."""
    encoder = pieces.Encoder(vocabulary)
    texts = [r["text"] for r in rows_of(documents(spark, SF001).select("text"))]
    off, ids = encoder.encode_many(pa.array(texts))
    assert 0.2 * sum(len(x) // 4 for x in encoder.known.values()) < encoder.early < len(ids)
    k = max(range(len(texts)), key=lambda k: len(set(texts[k])))
    assert ids[off[k]:off[k + 1]].tolist() == best_pieces(vocabulary, texts[k])


def test_paths_that_meet_late_are_left_to_the_stream():
    """Two segmentations of a long run (from its first or its second letter on) that never share a boundary."""
    v = pieces.Vocabulary(["<unk>", "a", "aa", "▁"] + [f"<0x{k:02X}>" for k in range(256)], np.array([0, -5, -1, -1] + [0.0] * 256), ["other"] + ["normal"] * 3 + ["byte"] * 256)
    texts = ["a" * n for n in (1, 2, 7, 24, 25, 47, 60)]
    off, ids = pieces.Encoder(v).encode_many(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == best_pieces(v, t)


def test_stream_keeps_a_bounded_window(vocabulary):
    stream, widest = pieces.Stream(vocabulary), 0
    for c in codes("the quick brown fox " * 200):
        stream.feed([c])
        widest = max(widest, len(stream.codes))
    assert widest < 10 * vocabulary.longest


def test_small_vocabulary_without_word_limits():
    v = pieces.Vocabulary(["<unk>", "a", "b", "ab", "b▁a", "▁", "▁a"] + [f"<0x{k:02X}>" for k in range(256)], np.array([0, -1, -1, -1.5, -1.2, -1, -1.5] + [0.0] * 256),
                          ["other"] + ["normal"] * 6 + ["byte"] * 256)
    assert not v.words_apart
    random.seed(9)
    texts = ["".join(random.choice("ab c") for _ in range(random.randint(0, 70))) for _ in range(200)]
    off, ids = pieces.Encoder(v).encode_many(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == best_pieces(v, t)


def test_encode_and_decode_rows(spark, vocabulary, edge, clashing, empty):
    for df in (edge, clashing):
        got = rows_of(pieces.decode(pieces.encode(df, vocabulary), vocabulary))
        assert sorted((r["doc_id"] or -1, r["decoded"]) for r in got) == sorted((r[0] or -1, r[1] or "") for r in edge_rows())
        assert all((r["ids"] == []) == (not r["text"]) for r in got)
    assert pieces.decode(pieces.encode(empty, vocabulary), vocabulary).count() == 0
    null = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert pieces.decode(null, vocabulary).first().decoded is None


def test_sentencepiece_query_is_a_round_trip(spark):
    got = rows_of(QUERIES["op8_sentencepiece"](spark, SF001))
    assert len(got) == documents(spark, SF001).count() and all(r["round_trip"] for r in got)


def test_attachments_are_read_back_from_the_text(spark):
    """Placeholders among escaped look-alikes; turns without attachments, null parts, an empty table."""
    text = lambda t: ("text", t, None, None)
    rows = [(1, 0, "user", [text("see <|image 1|> and \\<|"), ("image", None, "a.png", 785), text("then"), ("document", None, "b c.pdf", 3)]),
            (1, 1, "assistant", [("audio", None, "s.wav", 41), text("</turn>\n### user: <|audio 9|>")]),
            (2, 0, "user", [text("none")]), (3, 0, None, None), (4, 0, "user", [("image", None, "z", None)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,size:bigint>>")
    got = {r["conv_id"]: (r["n_attachments"], r["expanded_tokens"], r["attachments_sha256"]) for r in rows_of(chat.attached(chat.format_turns(df)))}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (3, 2 + 1200 + 2, digest("image a.png 2\ndocument b c.pdf 1200\naudio s.wav 2\n")), 4: (1, 0, digest("image z 0\n"))}
    assert chat.attached(chat.format_turns(df.limit(0))).count() == 0
