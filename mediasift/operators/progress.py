"""Progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import text_array
from ..functions.media import progress_percent


def progress_status(events: DataFrame) -> DataFrame:
    """Adds ``percent``; events that show nothing are dropped.

    Needs status, downloaded, total and estimate.
    """
    percent = progress_percent(F.col("status"), F.col("downloaded"), F.col("total"), F.col("estimate"))
    return events.withColumn("percent", percent).filter(F.col("percent").isNotNull())


def last_shown(ts: Column, event_id: Column) -> Column:
    """struct<status, percent> of the newest event, of equal times the one with the greatest id (not negative).

    Order and value are numbers of fixed width, which a hash aggregate can hold, so no job's events are sorted.
    """
    statuses = text_array(fixed.STATUSES)
    order = ts.cast("decimal(19,0)") * F.expr("CAST('1' || repeat('0', 19) AS DECIMAL(20, 0))") + event_id.cast("decimal(19,0)")
    code = F.col("percent").cast("int") * len(fixed.STATUSES) + F.array_position(statuses, F.col("status")).cast("int") - 1
    last = F.max_by(code, order.cast("decimal(38,0)"))
    return F.struct(
        F.get(statuses, last % len(fixed.STATUSES)).alias("status"), F.floor(last / len(fixed.STATUSES)).cast("bigint").alias("percent")
    )


def latest_progress(shown: DataFrame, job: str = "job", ts: str = "ts", event_id: str | None = None) -> DataFrame:
    """Last status and percent per job: one mergeable hash aggregate."""
    tie = F.lit(0) if event_id is None else F.col(event_id)
    return shown.groupBy(job).agg(last_shown(F.col(ts), tie).alias("last")).select(job, "last.status", "last.percent")
