"""Queries against DuckDB on the smallest tables, and the driver's three functions."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lakefold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
