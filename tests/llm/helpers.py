"""Fixtures and brute-force versions that the tests of this folder share."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF001 = "/root/testdata/sf0.001"

P = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from a very old oak tree near the quiet river bank "
     "and count every star that falls into the dark water before dawn breaks over hills of gold and grey stone").split()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(seed: int, n: int) -> str:
    """``n`` words that depend on the seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{x % 997}")
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    passage = " ".join(P)
    long_text = sentence(5, 3000)
    near = sentence(9, 200)
    rows = [
        (1, "plain text of a few words", "en", "a", 25),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "b", 4),
        (5, long_text, "en", "a", len(long_text)),
        (6, near, "en", "b", len(near)),
        (7, near.replace("w1", "x1", 1), "en", "b", len(near)),
        (8, near, "de", "c", len(near)),
        (9, sentence(21, 40) + " " + passage + " " + sentence(22, 60), "en", "a", 0),
        (10, sentence(23, 10) + "\n" + passage + "\n" + sentence(24, 5), "es", None, 0),
        (11, "Zażółć gęślą jaźń 🙂 日本語 " * 20, "pl", "d", 0),
        (11, "Zażółć gęślą jaźń 🙂 日本語 " * 20, "pl", "d", 0),
        (12, "x" * 5000, "en", "a", 5000),
        (13, "spam spam spam spam " * 30, "en", "c", 600),
        (None, "a row without an id but with some words in it", "en", "a", 45),
        (14, "\\ escaped ### text </turn> <|image 1|> \\\\", "en", "a", 0),
    ]
    return rows


def frame(spark, rows=None, extra: bool = False):
    """The rows as a documents table; ``extra``: with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("score", "lang_pred", "ids", "decoded", "kept", "block", "n_words", "spans", "size", "_range", "quality", "sketch", "weight", "rep", "hash"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
