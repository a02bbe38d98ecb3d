"""Every query with SQL gives the rows of DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from formweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = duck.execute(catalog.ORACLES[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    rows = result.fetchall()
    want = sorted((tuple(plain(r[have.index(c)]) for c in columns) for r in rows), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_agrees_with_itself(spark, name):
    """Queries without SQL have rows, and the same in a second run over other partitions."""
    first = sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
