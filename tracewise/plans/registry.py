"""Query catalogue: one Spark plan per key, plus its DuckDB oracle SQL.

Keys are the names in SURVEY §7.8.  Each Spark callable takes
``(spark, sf_dir)`` and returns a DataFrame; oracle SQL runs on the same
parquet tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def register(key: str, operators: str, sql: str | None = None):
    """Register a Spark plan under ``key``; ``sql`` is its oracle (or None)."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        OPERATORS[key] = operators
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco
