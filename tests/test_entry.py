"""Registered queries against their SQL oracle on the smallest driver tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
check = importlib.import_module("tools.check_oracle")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, str(SF_DIR))
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([d[0] for d in con.description], con.fetchall())
