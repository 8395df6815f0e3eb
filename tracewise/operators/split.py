"""Splitting and sampling.

Python's ``random.shuffle`` cannot be reproduced, so the shuffle order is the
portable hash key (ids of any type) of ``tracewise.functions.common.hash_key`` with the id as
tie-break (documented deviation, SURVEY T9).  Positions inside a stratum come
from ``grouped_position`` (bucketed exact rank), so a stratum holding a third
of all chains is still ranked by thousands of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, hash_key, r6
from tracewise.functions.ranking import grouped_position


def chain_strata(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain_id, domain, has_error) – has_error = any step not correct."""
    err = steps.groupBy("chain_id").agg(F.max((~F.col("is_correct")).cast("int")).alias("_e"))
    return (chains.join(err, "chain_id", "left")
            .select("chain_id", "domain", (F.coalesce("_e", F.lit(0)) == 1).alias("has_error")))


def assign_splits(items: DataFrame, strata: list[str], id_col: str = "chain_id",
                  train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Per stratum, shuffled order; first int(n*train) -> train, next
    int(n*val) -> val, rest -> test.  Ratios must sum to 1 (1e-6)."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    keyed = items.withColumn("_k", hash_key(id_col, seed))
    keyed, strata = (keyed, strata) if strata else (keyed.withColumn("_g", F.lit(0)), ["_g"])
    pos = grouped_position(keyed, strata, "_k", id_col, out="_pos", size_col="_n")
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    split = (F.when(F.col("_pos") < n_train, "train")
             .when(F.col("_pos") < n_train + n_val, "val").otherwise("test"))
    return pos.withColumn("split", split).drop("_k", "_pos", "_n", "_g")


def split_stats(split_chains: DataFrame) -> DataFrame:
    """S3: per split totals, by domain and by has_error (grouping sets)."""
    return (split_chains.groupingSets([["split"], ["split", "domain"], ["split", "has_error"]],
                                      "split", "domain", "has_error")
            .agg(F.count(F.lit(1)).alias("n")))


def holdout(items: DataFrame, id_col: str = "chain_id", val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """First int(n*val_ratio) in shuffled order = val, rest = train."""
    keyed = items.withColumn("_g", F.lit(0)).withColumn("_k", hash_key(id_col, seed))
    pos = grouped_position(keyed, ["_g"], "_k", id_col, out="_pos", size_col="_n")
    return (pos.withColumn("split", F.when(F.col("_pos") < F.floor(F.col("_n") * val_ratio), "val").otherwise("train"))
            .drop("_g", "_k", "_pos", "_n"))


def normalise_text(c) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def split_leakage(split_items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """For every pair of splits, how many ids and how many normalised
    texts occur in both.  One aggregation per key (no pairwise join), so a
    text copied a million times is still one partial-aggregated group."""
    splits = ["train", "val", "test"]

    def flags(key):
        return (split_items.groupBy(key)
                .agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in splits]))

    by_id = flags(id_col)
    by_text = flags(F.sha2(normalise_text(F.col(text_col)), 256).alias("_t"))
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]

    def counts(df, name):
        return df.agg(*[F.sum(F.col(a) * F.col(b)).cast("long").alias(f"{a}_{b}") for a, b in pairs]).select(
            F.inline(F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                                        F.col(f"{a}_{b}").alias(name)) for a, b in pairs])))

    return counts(by_id, "shared_ids").join(counts(by_text, "shared_texts"), ["split_a", "split_b"])


def class_balance(steps: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """S7 (+ D6): origin / non-origin counts and pos_weight = neg/(pos+1e-8)
    per domain, with the per-domain origin threshold when given."""
    c = steps.groupBy("domain").agg(F.sum(F.col("is_origin").cast("int")).cast("long").alias("pos"),
                                    F.sum((~F.col("is_origin")).cast("int")).cast("long").alias("neg"))
    c = c.select("domain", "pos", "neg", r6(F.col("neg") / (F.col("pos") + F.lit(1e-8))).alias("pos_weight"))
    if thresholds is not None:
        c = c.join(broadcast_if_small(thresholds), "domain", "left")
    return c
