"""Every registered query runs on the smallest tables and, where it has an SQL
twin, gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points  # on the path through conftest
from mediasift.suite.load import QUERIES

from .conftest import SMALL

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == ordered(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200


def test_every_oracle_has_a_query():
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()
