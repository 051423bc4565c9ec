"""Every registered query against its DuckDB oracle SQL on sf0.001 (rows-only
for the queries without SQL).  Same comparison as the driver: column names,
row count and order-insensitive values (floats at 6 decimals)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from annospark.plans.standins import TABLES  # noqa: E402
from oracle_check import norm  # noqa: E402

SF = os.environ.get("ANNOSPARK_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(sp.columns) > 0
        return
    dk = con.execute(SQL[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    a, b = norm(sp), norm(dk)
    assert a.equals(b)
