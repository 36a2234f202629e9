"""Structured Streaming jobs. Each is started by the caller with its own
checkpoint folder and trigger; ``availableNow`` drains a source and stops."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import Engines
from ..operators.audit import audit_rows
from ..operators.contracts import POST_CHARS
from ..operators.manifest import explode_artifacts, resolved_path
from ..operators.progress import latest_progress, progress_status
from ..plans.run_analysis import ToolName, analysis_audit, cache_puts, run_analysis
from ..session import DEFAULTS, remove
from ..sources.cache_log import CacheLog, CacheView
from ..sources.tables import put_cache
from .admission import admitted


def _available(query, checkpoint: str):
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True)


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ``transformWithState`` asks for; Spark's default store cannot
    hold it. A stream has its own copy of the settings from its start on, so the session gets back what it had."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, DEFAULTS[name])
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def once(rows: DataFrame, key: str, ts: str | None, delay: str) -> DataFrame:
    """The first row of each ``key``, kept in the state store for ``delay`` of event time.

    The event time is ``ts``, or the time of arrival where there is none. Repeats within ``delay`` are dropped, and so are rows
    that come more than ``delay`` behind the newest. Rows without key or event time cannot be told apart and all stay.
    """
    at = F.current_timestamp() if ts is None else F.col(ts).cast("timestamp")
    named = F.col(key).isNotNull() & at.isNotNull()
    timed = rows.filter(named).withColumn("_at", at).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at").unionByName(rows.filter(~named))


def stream_audit(
    outcomes: DataFrame,
    path: str,
    checkpoint: str,
    *,
    request: str = "trace_id",
    ts: str | None = None,
    delay: str = "1 hour",
    tool_name: str = "download_media",
    tool_version: str = "1.5.0",
) -> StreamingQuery:
    """Append-only audit table with one row for each request, however often it is sent (see ``once``).

    The file sink commits each batch exactly once, so a batch that runs again adds nothing.
    """
    rows = audit_rows(once(outcomes, request, ts, delay), tool_name=tool_name, tool_version=tool_version)
    return _available(
        rows.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint
    ).start()


def stream_analyze(
    requests: DataFrame,
    files: DataFrame,
    observations: DataFrame,
    *,
    root: str,
    folder: str,
    replies: DataFrame | None = None,
    engines: Engines = Engines(),
    tool: ToolName = ToolName(),
    ts: str | None = None,
    delay: str = "1 hour",
    post_chars: int | None = POST_CHARS,
) -> StreamingQuery:
    """Analyses requests as they land: each request once (see ``once``), one computation per cache key.

    Per batch: results are written below ``results/batch=N``, and the audit rows
    and cache entries are derived from that written table. Its requests are kept below ``landed``
    until their results are written. A batch reads only the
    entries of earlier batches that can answer it, and the rows of files and observations that it names, and
    replaces its own folders, so a repeated batch changes nothing.
    """
    cache_path = f"{folder}/cache"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The state store is asked once for the batch, whatever reads it; each reader takes the columns it needs.
        landed = f"{folder}/landed/batch={number}"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(landed)
        batch = spark.read.schema(batch.schema).parquet(landed)
        cache = CacheView(CacheLog(spark, cache_path), before=number)
        named = explode_artifacts(batch).select(resolved_path("path", root).alias("path")).distinct()
        results = run_analysis(
            batch, files.join(named, "path", "left_semi"), observations, root=root, cache=cache, replies=replies, engines=engines,
            post_chars=post_chars,
        )
        out = f"{folder}/results/batch={number}"
        results.write.mode("overwrite").option("compression", "zstd").parquet(out)
        remove(spark, landed)
        written = spark.read.schema(results.schema).parquet(out)
        analysis_audit(written, tool).write.mode("overwrite").parquet(f"{folder}/audit/batch={number}")
        put_cache(cache_puts(written), cache_path, number)

    first = once(requests, "request_id", ts, delay)
    return _available(first.writeStream.foreachBatch(handle), f"{folder}/checkpoint").start()


def stream_throttle(calls: DataFrame, interval: int, *, folder: str, delay: int) -> StreamingQuery:
    """Admission times over an unbounded stream of calls (key, call_id, ts), below ``folder/admitted``.

    Times, ``interval`` and ``delay`` are microseconds. Calls of one batch are admitted in the order of time, after those of
    earlier batches; calls more than ``delay`` behind the newest are dropped. ``delay`` is at least ``interval``.
    The state is one row a key in the state store until a timer clears it; the sink commits a batch once.
    """
    if delay < interval:
        raise ValueError("delay must be at least interval")
    rows = admitted(calls, interval, delay)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/admitted")
    with _state_in_rocksdb(calls.sparkSession):
        return _available(writer, f"{folder}/checkpoint").start()


def stream_progress(events: DataFrame, folder: str) -> StreamingQuery:
    """Current status per job, kept in Spark's state store; each batch writes
    only the jobs that changed, below ``changes/batch=N``."""
    current = latest_progress(progress_status(events), "job", "ts", "event_id")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return _available(
        current.writeStream.outputMode("update").foreachBatch(handle), f"{folder}/checkpoint"
    ).start()


__all__ = [
    "stream_analyze",
    "stream_audit",
    "stream_progress",
    "stream_throttle",
]
