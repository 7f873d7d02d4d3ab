"""Every registered query on the smallest driver tables, against DuckDB where SQL exists."""

import os

import pytest

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    from check import compare

    outcome = compare(spark, duck, SMALLEST, name)
    assert not outcome.startswith("FAIL"), outcome


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 21
