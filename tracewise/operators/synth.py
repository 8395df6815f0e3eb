"""Synthetic labelled chains (Q1) and dataset balance (Q3).

Q1 generates chains with ``spark.range`` (no driver-side loop): every third
chain has its origin at step 2 and all later steps wrong.  It has no table
input, so it is a library generator for tests and load checks, not a
registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_chains(spark: SparkSession, n: int, steps: int = 4, error_step: int = 2, every: int = 3) -> DataFrame:
    """Q1: long-form steps of ``n`` medical chains."""
    c = spark.range(n).withColumnRenamed("id", "i")
    err = F.col("i") % every == 0
    s = c.select("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx"))
    wrong = (F.col("i") % every == 0) & (F.col("idx") >= error_step)
    return s.select(F.concat(F.lit("medical_synthetic_"), F.col("i").cast("string")).alias("chain_id"),
                    F.col("idx").cast("long").alias("idx"), F.col("idx").cast("long").alias("step_id"),
                    F.lit("medical").alias("domain"),
                    F.concat(F.lit("Medical reasoning step "), (F.col("idx") + 1).cast("string"),
                             F.lit(": Analyze symptom and diagnosis")).alias("text"),
                    (~wrong).alias("is_correct"), (err & (F.col("idx") == error_step)).alias("is_origin"),
                    F.when(wrong, F.lit("factual")).alias("error_type"))


def dataset_balance(steps: DataFrame) -> DataFrame:
    """Q3: chains, nodes, correct / incorrect nodes (with shares) and origins."""
    a = steps.agg(F.countDistinct("chain_id").alias("total_chains"), F.count(F.lit(1)).alias("total_nodes"),
                  F.sum(F.col("is_correct").cast("long")).alias("correct_nodes"),
                  F.sum(F.col("is_origin").cast("long")).alias("origin_nodes"))
    return a.select("total_chains", "total_nodes", "correct_nodes",
                    (F.col("total_nodes") - F.col("correct_nodes")).alias("incorrect_nodes"),
                    F.round(F.col("correct_nodes") * 100.0 / F.col("total_nodes"), 1).alias("correct_pct"),
                    F.round((F.col("total_nodes") - F.col("correct_nodes")) * 100.0 / F.col("total_nodes"), 1).alias("incorrect_pct"),
                    "origin_nodes")
