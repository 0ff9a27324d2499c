"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(float(value), 6) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert len(registry.QUERIES[name](spark, FOLDER).toPandas()) > 0


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
