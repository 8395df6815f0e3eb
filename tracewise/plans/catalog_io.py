"""IO queries (IO1–IO9, IO12): write chains / pattern stores to the shared
checkpoint folder, read them back through ``tracewise.sources.io`` and
report what was read.  Every 97th chain is written truncated, so the
corrupt-record path (IO6) sees real malformed lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewise.operators import convert, patterns
from tracewise.plans.catalog_convert import math_raw
import tracewise.plans.catalog_risk  # noqa: F401  (registers pattern_stats, whose oracle is reused)
from tracewise.plans.registry import ORACLES, register
from tracewise.session import checkpoint_dir
from tracewise.sources import io
from tracewise.sources.fixtures import order_lines, order_steps, with_views


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("chain_io_roundtrip", "IO1 IO3 IO6", with_views("""
    with o as (select distinct chain_id, first_supp from order_base)
    select 'model_' || cast(first_supp % 4 as varchar) as model_type, count(*) as total,
           count(*) filter (where chain_id % 97 <> 0) as valid, count(*) filter (where chain_id % 97 = 0) as invalid
    from o group by 1""", "order_base"))
def q_chain_io_roundtrip(spark, sf_dir):
    chains = convert.convert_math(math_raw(spark, sf_dir))
    model = (order_lines(spark, sf_dir).filter(F.col("idx") == 0)
             .select(F.col("chain_id").cast("string").alias("query_id"),
                     F.concat(F.lit("model_"), (F.col("first_supp") % 4).cast("string")).alias("model")))
    line = F.to_json(F.struct(*[F.col(c) for c in ["domain", "query_id", "query", "ground_truth", "reasoning_steps",
                                                 "dependency_graph"]]))
    broken = F.col("query_id").cast("long") % 97 == 0
    out = chains.join(model, "query_id").select(F.when(broken, F.substring(line, 1, 40)).otherwise(line).alias("value"),
                                                "model")
    path = _scratch(spark, "chains")
    out.write.partitionBy("model").option("compression", "gzip").text(path)
    back = io.read_chains(spark, path).withColumn("model_type", F.regexp_extract(F.col("_metadata.file_path"), "model=([^/]+)", 1))
    return back.groupBy("model_type").agg(F.count(F.lit(1)).alias("total"),
                                          F.count(F.when(F.col("parse_error").isNull(), 1)).alias("valid"),
                                          F.count(F.when(F.col("parse_error").isNotNull(), 1)).alias("invalid"))


@register("pattern_store_io", "IO9", ORACLES.get("pattern_stats"))
def q_pattern_store_io(spark, sf_dir):
    store = patterns.pattern_store(patterns.extract_occurrences(order_steps(spark, sf_dir)))
    path = _scratch(spark, "patterns")
    io.save_pattern_store(store, path)
    _, stats = io.load_pattern_store(spark, path)
    return stats

