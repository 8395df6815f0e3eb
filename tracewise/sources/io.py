"""Chain sources and sinks (IO1–IO14).

* read_chains   – JSON Lines with an explicit schema (IO1), gzip by suffix
  (IO3), PERMISSIVE mode keeping the raw text of bad lines (IO6); unknown
  domains / error types count as parse errors like the reference's enum
  constructors
* read_capped   – first N by a deterministic order (IO2)
* read_dataset  – parquet dataset that must have a ``train`` split (IO4)
* file keys     – ``_metadata.file_name`` + ``regexp_extract`` (IO5)
* file_stats    – one read of a whole directory, per-file counts (IO12)
* write_*       – JSONL / parquet / report sinks (IO7, IO8); pattern store
  save/load with statistics rebuilt on load (IO9)
* preference_pairs – chosen/rejected sides -> chains (IO13)
* distinct_models  – model names over two columns (IO14)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.schema import CHAIN, DOMAINS, ERROR_TYPES

CORRUPT = "_corrupt_record"


def read_chains(spark: SparkSession, paths, with_file: bool = True) -> DataFrame:
    """IO1 + IO3 + IO6: chains with ``parse_error`` (null when the line is a
    valid chain).  Bad JSON keeps its raw text; a domain or error type
    outside the enums is an error too."""
    schema = T.StructType(CHAIN.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(paths))
    if with_file:
        df = df.withColumn("file_name", F.col("_metadata.file_name"))
    bad_type = F.exists(F.coalesce("reasoning_steps", F.array()),
                        lambda s: s["error_type"].isNotNull() & ~s["error_type"].isin(ERROR_TYPES))
    err = (F.when(F.col(CORRUPT).isNotNull(), F.lit("Parse error: malformed JSON"))
           .when(~F.col("domain").isin(DOMAINS) | F.col("domain").isNull(), F.concat(F.lit("Parse error: bad domain "), F.coalesce("domain", F.lit("null"))))
           .when(bad_type, F.lit("Parse error: bad error_type")))
    # defaults of the reference codec: missing is_origin -> False, depends_on -> []
    steps = F.transform("reasoning_steps", lambda s: s.withField("is_origin", F.coalesce(s["is_origin"], F.lit(False)))
                        .withField("depends_on", F.coalesce(s["depends_on"], F.array().cast("array<int>")))
                        .withField("error_type", F.when(s["error_type"] != "", s["error_type"])))
    return df.withColumn("reasoning_steps", steps).withColumn("parse_error", err)


def read_capped(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """IO2: the first ``n`` records by an explicit order (the reference reads
    the first N lines; file order is not a Spark notion)."""
    return df.orderBy(*order).limit(n)


def read_dataset(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """IO4: parquet dataset laid out as ``split=<name>``; the split must exist."""
    df = spark.read.parquet(path)
    if "split" not in df.columns or df.filter(F.col("split") == split).limit(1).count() == 0:
        raise ValueError(f"dataset at {path} has no '{split}' split")
    return df.filter(F.col("split") == split)


def key_from_file_name(df: DataFrame, col: str = "file_name") -> DataFrame:
    """IO5: ``{model}_{domain}_chains.jsonl``, or one of several ``{model}_{domain}_chains-NNNNN.jsonl`` -> model (stem before
    the first '_') and domain."""
    return (df.withColumn("model_type", F.regexp_extract(col, r"^([^_]+)_", 1))
            .withColumn("file_domain", F.regexp_extract(col, r"_([^_]+)_chains(-\d+)?\.jsonl(\.gz)?$", 1)))


def file_stats(chains: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """IO12 + V2: per file total / valid / invalid (parse errors, plus
    structural messages when given)."""
    c = chains
    if messages is not None:
        bad = messages.select(F.col("chain_id").alias("query_id")).distinct().withColumn("_v", F.lit(1))
        c = c.join(bad, "query_id", "left")
    else:
        c = c.withColumn("_v", F.lit(None))
    invalid = F.col("parse_error").isNotNull() | F.col("_v").isNotNull()
    return c.groupBy("file_name").agg(F.count(F.lit(1)).alias("total"),
                                      F.count(F.when(~invalid, 1)).alias("valid"),
                                      F.count(F.when(invalid, 1)).alias("invalid"))


def write_chains_jsonl(chains: DataFrame, path: str, compression: str | None = None,
                       partition_by: list[str] | None = None) -> None:
    """IO7: one JSON line per chain."""
    w = chains.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def name_files(spark: SparkSession, path: str, column: str, pattern: str) -> None:
    """IO5: moves the part files of each ``column=value`` folder up to ``pattern`` filled with the value and a number
    (``{}_math_chains-{:05d}.jsonl``), in the order of their names; names only, the driver sees no data."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(root):
        name = d.getPath().getName()
        if not name.startswith(f"{column}="):
            continue
        parts = sorted(f.getPath().getName() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-"))
        for k, part in enumerate(parts):
            to = pattern.format(name.split("=", 1)[1], k)
            if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(d.getPath(), part), spark._jvm.org.apache.hadoop.fs.Path(path, to)):
                raise OSError(f"cannot name {name}/{part} {to}")


def write_lookup(df: DataFrame, path: str, key: str = "chain_id", group_bytes: int = 1 << 20) -> None:
    """V7: a table for point lookups: range-partitioned and sorted by ``key``, with row groups of about ``group_bytes`` and a bloom
    filter on the key in each, so that a lookup reads footers, filters and the one row group that has the key."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
     .option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "chain_id") -> DataFrame:
    """IO1/IO4/IO9: ``df`` as the table ``name`` at ``path``, in ``buckets`` files (a task writes whole buckets) by ``key``, each sorted by it.

    Reads keep that layout: grouping by the key, or joining tables of as many buckets by it, takes no shuffle.  Joins by the key and
    further columns keep it too where ``spark.sql.requireAllClusterKeysForCoPartition`` is false."""
    spark = df.sparkSession
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    return spark.table(name)


def write_report(report: DataFrame, path: str) -> None:
    """IO8: a report table as JSON lines."""
    report.write.mode("overwrite").json(path)


def save_pattern_store(store: DataFrame, path: str) -> None:
    """IO9 save: only the patterns; statistics are derived, never stored."""
    store.write.mode("overwrite").parquet(path)


def load_pattern_store(spark: SparkSession, path: str):
    """IO9 load: the store and its statistics rebuilt by one group-by."""
    from tracewise.operators.patterns import model_stats

    store = spark.read.parquet(path)
    return store, model_stats(store)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """IO10: the parquet table at ``path`` if a finished one is there, else
    ``build()`` written there first.  A failed write leaves no ``_SUCCESS`` and
    is built anew."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def preference_pairs(pairs: DataFrame, mapping: list[tuple[str, str]], cap: int | None = None) -> DataFrame:
    """IO13: unpivot chosen / rejected sides into (model_name, conversation);
    keep sides whose model name contains a mapped key (first key in order; the
    mapping is a list written in code, so the match is a projection) and, when
    ``cap`` is given (500 in the reference), at most that many conversations per
    mapped model, by row order.
    pairs: (pair_id, chosen_model, chosen array<struct<role,content>>,
    rejected_model, rejected array<struct<role,content>>);
    mapping: [(key, model_type)]."""
    sides = pairs.select("pair_id", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("chosen_model").alias("model_name"), F.col("chosen").alias("conversation")),
        F.struct(F.lit(1).alias("side"), F.col("rejected_model").alias("model_name"), F.col("rejected").alias("conversation")))))
    known = F.coalesce(*[F.when(F.col("model_name").contains(k), m) for k, m in sorted(mapping)], F.lit(None).cast("string"))
    j = sides.withColumn("model_type", known).filter(F.col("model_type").isNotNull())
    if cap is None:
        return j
    # first ``cap`` per model without sorting a whole model in one task:
    # keep the cap smallest per (model, salt), then per model among those
    salted = j.withColumn("_salt", F.pmod(F.xxhash64("pair_id"), F.lit(64)))
    w1 = Window.partitionBy("model_type", "_salt").orderBy("pair_id", "side")
    cand = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= cap)
    w2 = Window.partitionBy("model_type").orderBy("pair_id", "side")
    return cand.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= cap).drop("_rn", "_salt")


def distinct_models(df: DataFrame, a: str, b: str) -> DataFrame:
    """IO14: sorted distinct names over two columns."""
    return (df.select(F.col(a).alias("model")).union(df.select(F.col(b).alias("model")))
            .filter(F.col("model").isNotNull()).distinct().orderBy("model"))
