import importlib.util
import os

import duckdb
import pytest

from tests.conftest import SF001
from tracewise.sources.tables import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_smoke(spark):
    m = _entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["model_type", "domain", "total_steps", "accuracy", "error_rate", "rnk"]


def test_every_oracle_has_a_query():
    m = _entry()
    assert set(m.oracle_sql()) <= set(m.queries())


def _keys():
    """Those of the library; the training-data queries are run by their own tests."""
    m = _entry()
    return sorted(set(m.queries()) - set(m.LLM_QUERIES))


@pytest.mark.parametrize("key", _keys())
def test_query_runs_on_sf0001(spark, key):
    """The whole result is computed; with an oracle, as many rows as it has."""
    m = _entry()
    df = m.queries()[key](spark, SF001)
    assert len(df.columns) == len(set(df.columns)), "duplicate output column names"
    n = len(df.collect())
    sql = m.oracle_sql().get(key)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
        assert n == len(con.execute(sql).fetchall())
