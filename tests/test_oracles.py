"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from meterwise.sources.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("~",)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (bool, int, float)):
        return ("n", round(float(v), 6) + 0.0)
    if hasattr(v, "isoformat"):
        return ("s", v.isoformat()[:10])
    return ("s", str(v))


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_canon(x) for x in rec) for rec in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 52 and df.count() > 0
