"""Queries over documents with empty and blank texts give the rows of their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points  # on the path through conftest
from mediasift.suite.load import QUERIES

from .conftest import SMALL

TEXTS = ("", " \n\t", "　", "a", "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with more documents, of each text one a source; the last empty ones repeat the first."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in os.listdir(SMALL):
        if name != "documents.parquet":
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame(
        [(10**6 + 100 * i + s, t, ("en", "de", "es", "fr")[s % 4], f"src{s}", len(t)) for i, t in enumerate(TEXTS) for s in range(13)],
        docs.schema,
    )
    docs.unionByName(more).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def agrees(spark, folder, name):
    got = QUERIES[name](spark, folder)
    connection = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        path = f"{folder}/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = connection.execute(entry_points.oracle_sql()[name])
    places = [[c[0] for c in cursor.description].index(c) for c in got.columns]
    want = sorted(str(tuple(r[i] for i in places)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_validate_outputs(spark, tables):
    agrees(spark, tables, "validate_outputs")


def test_validate_analysis_requests(spark, tables):
    agrees(spark, tables, "validate_analysis_requests")


def test_analyze_with_model(spark, tables):
    agrees(spark, tables, "analyze_with_model")


@pytest.mark.parametrize("name", ["stream_analyze", "run_analysis"])
def test_summary_without_text(spark, tables, name):
    agrees(spark, tables, name)
