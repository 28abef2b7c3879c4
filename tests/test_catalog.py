"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from arterial.plans import catalog


def normal(v):
    return f"{v:.8g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_duckdb(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    result = duck.execute(catalog.ORACLES[name])
    cols = [x[0] for x in result.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(normal(r[cols.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(normal(r[c]) for c in order) for r in rows) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

