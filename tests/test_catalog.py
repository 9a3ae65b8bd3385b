"""Every catalogued query on the smallest tables, against its SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

SF = Path(os.environ.get("TIDEWELL_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, SQL = driver.queries(), driver.oracle_sql()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).values)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["ridge", "walk_forward_cv", "recommend_with_model"])
def test_query_without_sql_runs(spark, name):
    assert not QUERIES[name](spark, str(SF)).isEmpty()


def test_flagship_counts_every_hour(spark):
    hours = driver.entry(spark).agg({"hours": "sum"}).first()[0]
    assert hours == QUERIES["passthrough_frame"](spark, str(SF)).count()
