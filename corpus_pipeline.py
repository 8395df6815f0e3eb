"""A training corpus from raw documents: five stages, each one operator of ``tracewise.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.  Other columns of the input are left behind.  Null and
empty texts have no letter, so the first stage rejects them; null ids pass through all stages, as documents like others (a copy
without an id is a copy); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import langid, minhash, mixing, pieces, substring
from tracewise.llm.common import documents, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_EVIDENCE = 1.0  # of a document's n-grams for its language, in nats each; documents in a known language have 2 to 5
LIKENESS = 80  # near-duplicates share at least so many of 100 shingles


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: without a letter, or whose n-grams fit even the best language badly."""
    docs = docs.select(*COLUMNS)
    known = langid.predict(docs, langid.fit(docs))
    return known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("evidence") >= LEAST_EVIDENCE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """Keeps one row of each class of near-duplicates: of the smallest id, rows without one last (and one of equal rows).

    Rows are told apart by all their columns, so two texts of one id are judged each for itself.  ``percent`` has the operator's
    default; the stage passes LIKENESS.
    """
    docs = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))
    classes = minhash.near_duplicates(docs, percent=percent, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    ids = docs.select("_row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    kept = classes.join(ids, "_row").groupBy("component_id").agg(first).select("first._row")
    return docs.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated 35-word windows from the texts; a document of which nothing is left goes."""
    left = substring.remove_repeated_windows(docs.select(*COLUMNS), carry=("lang", "source"), keep_layout=True)
    left = left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents as often as the mix of sources to their targets takes them (0 to 2 times)."""
    # numbered and written, so that the numbers stay and rows of one id (or none) keep counts of their own
    docs = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    taken = mixing.mix_sources(docs, carry=("_row",)).filter("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return docs.join(taken, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, with how many they are."""
    vocabulary = pieces.load(pieces.default_path())
    encoded = pieces.encode(docs.select(*COLUMNS), vocabulary)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", partial(near_dedup, percent=LIKENESS)),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("tokenise", tokenise),
]

#: The stages learn models, estimate and hash, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
