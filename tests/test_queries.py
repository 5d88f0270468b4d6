"""Every registered query against its SQL text, run by DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as contract
from workloads import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (decimal.Decimal, datetime.date, bytearray)):
        return str(value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, found) == bag(columns, result.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) <= set(SQL) <= set(QUERIES)


def test_entry_reports(spark):
    assert contract.entry(spark).count() == 2
