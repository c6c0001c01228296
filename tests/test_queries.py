"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CORE = sorted(k for k in entry.core.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, datetime):
        return str(v.date())
    return None if v is None or v != v else str(v)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in answer.fetchall()), key=str)
    assert rows == want


def test_entry(spark):
    got = {r.name: r.value for r in entry.entry(spark).collect()}
    assert got["revenue > 0"] == "true" and float(got["revenue"]) > 0
