"""Result reuse by cache key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = "^[0-9a-f]{64}$"


def valid_key(column: str = "cache_key"):
    return (F.length(column) == 64) & F.col(column).rlike(KEY)


def latest_per_key(puts: DataFrame, order: str) -> DataFrame:
    """Last writer wins. ``order`` is a number that no two rows of a key share.

    The winning number of a key is a hash aggregate over two narrow columns; only then are the rows looked up.
    """
    newest = puts.groupBy("cache_key").agg(F.max(order).alias(order))
    return puts.join(newest, ["cache_key", order], "left_semi").select("cache_key", *(c for c in puts.columns if c not in ("cache_key", order)))


def join_known(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on a key that may be null in very many rows.

    A null matches nothing; here it is dealt out by request id, so that these rows
    do not meet in one task. ``other`` has no null key.
    """
    dealt = F.coalesce(F.col(key), F.concat(F.lit("no key: "), F.col("request_id").cast("string")))
    return rows.withColumn("_key", dealt).join(other.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def cache_lookup(requests: DataFrame, cache: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``cached``, the stored output; null for misses and forced requests.

    One left join serves hits and misses. A key many requests share skews the
    request side only: the cache has one row per key, so the adaptive skew join
    can split the request side.
    """
    stored = cache.filter(valid_key()).select("cache_key", F.col(output).alias("_stored"))
    return (
        join_known(requests, stored, "cache_key")
        .withColumn("cached", F.when(~F.col("force_reanalyze"), F.col("_stored")))
        .drop("_stored")
    )


def mark_first(requests: DataFrame, *order: str) -> DataFrame:
    """Adds ``computes``: this request is the first of its key in the batch.

    The key is ``work_key`` where given (null: nothing to compute), else ``cache_key``.

    The first request per key is a mergeable minimum; it comes back by request
    id, which is unique, so a key that a third of all requests share never
    gathers its rows in one task.
    """
    work = "work_key" if "work_key" in requests.columns else "cache_key"
    grouped = requests.filter(F.col(work).isNotNull()).groupBy(work)
    if order:
        picked = grouped.agg(F.min(F.struct(*order, "request_id")).alias("f")).select("f.request_id")
    else:
        picked = grouped.agg(F.min("request_id").alias("request_id")).select("request_id")
    first = picked.withColumn("_first", F.lit(True))
    return requests.join(first, "request_id", "left").withColumn(
        "computes", F.coalesce(F.col("_first"), F.lit(False))
    ).drop("_first")
