"""Result and cache tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import tenant_partition
from .cache_log import CacheLog


def write_analysis(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results below one folder per tenant."""
    results.withColumn("tenant", tenant_partition(F.coalesce("tenant_id", F.lit("")))).write.partitionBy(
        "tenant"
    ).mode("append").format(fmt).save(path)


def save_bucketed(rows: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Stores a table in buckets of ``key``, each sorted by it.

    Requests, observations and replies by ``request_id`` meet in ``analyze_content`` without an exchange, and files by
    ``path`` meet a manifest with one on the manifest's side only, if all have as many buckets. Rows of
    one bucket are in one file a writing task, so the rows are dealt by the same hash before.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def put_cache(puts: DataFrame, path: str, batch: int) -> None:
    """Adds (cache_key, output) to the cache table; see ``cache_log``. A batch
    number orders the writers, and re-running a batch replaces its own rows."""
    CacheLog(puts.sparkSession, path).put(puts, batch)


def read_cache(spark: SparkSession, path: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(cache_key, output), last writer per key; unreadable entries are left out
    and so count as misses. With ``before`` only entries of earlier batches count;
    with ``keys`` only what may hold one of these keys is read."""
    return CacheLog(spark, path).entries(keys, before)
