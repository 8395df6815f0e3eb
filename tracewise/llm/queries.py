"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import chat, jaccard_join, langid, merkle, minhash, mixing, pieces, quality, rules, sketch, substring, suffix, whitening
from tracewise.llm.common import documents
from tracewise.llm.oracles import ORACLES  # noqa: F401
from tracewise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return minhash.near_duplicates(documents(spark, sf_dir))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose texts hold control strings, formatted and read back from the output: once as they are, and
    once with attachments derived from their turns, of which references and token counts are read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(r"select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, r'\### Assistant: </turn> ok' as text "
                       "from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    turns = turns.unionByName(tricky)
    told = chat.read_back(chat.format_turns(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))
    # the same turns with typed parts: an image and a document behind what is asked, audio before what is answered
    length, ref = F.length(F.coalesce("text", F.lit(""))), lambda kind: F.concat_ws("-", F.lit(kind), "conv_id", "turn")
    text = chat.text_parts(F.col("text"))
    asked = F.concat(text, F.array(chat.part("image", ref("image"), length % 50 * chat.PIXELS_A_TOKEN + 1), chat.part("document", ref("document"), F.col("turn") % 3)))
    answered = F.concat(F.array(chat.part("audio", ref("audio"), length * chat.MS_A_TOKEN)), text)
    parts = F.when(F.col("role") == chat.LOSS_ROLE, answered).otherwise(asked)
    files = chat.attached(chat.format_turns(turns.select("conv_id", "turn", "role", parts.alias("parts"))))
    return told.drop("n_attachments", "expanded_tokens").join(files, "conv_id")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when each word inside a repeated 35-word window is removed."""
    d = substring.remove_repeated_windows(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to the edited and the next text."""
    d = sketch.fingerprints_with_edits(documents(spark, sf_dir))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                    sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                    sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                    sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
                    sketch.distinct_shingles(F.col("sketch")).alias("n_shingles_estimate"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left when those inside a 50-byte string of a smaller document are removed."""
    d = suffix.remove_seen_bytes(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of documents that are not held out."""
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", held().alias("held_out"), "n_chars", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held())
    model = quality.fit(docs, labels, metadata=("n_chars",))
    scored = quality.score(docs, model, metadata=("n_chars",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to piece ids and decoded again from them."""
    vocabulary = pieces.load(pieces.default_path())
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                    F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when the sources are mixed to their targets."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "weight")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base verdict and the weakly supervised verdict of every document."""
    return rules.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                       "base_failed", "kept", "quality")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document, a third of them tampered with."""
    return merkle.verify(documents(spark, sf_dir))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector projected on the first 32 components, scaled to unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of at least 0.80."""
    return jaccard_join.similarity_join(documents(spark, sf_dir))
