"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from inkwell.plans import catalogue
from inkwell.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return c


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value) + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    wanted = duck.sql(catalogue.ORACLES[name])
    assert sorted(wanted.columns) == columns
    rows = wanted.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
