"""Admission times under a minimum interval per key.

admit_1 = ts_1, admit_i = max(ts_i, admit_{i-1} + d) has the closed form
admit_i = i*d + max over j <= i of (ts_j - j*d), with i counted within the key.
A running count and a running maximum are both prefix scans, so long keys are
cut into blocks (see ``blocks``): inside a block with local number j the
value is ts - j*d, and the block's offset is n_before rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import all_true
from ..functions.urls import throttle_host
from .blocks import in_blocks


def throttle_key(tenant: Column, bucket: str, first_url: Column) -> Column:
    return F.concat_ws(":", tenant, F.lit(bucket), throttle_host(first_url))


def throttle_schedule(
    calls: DataFrame,
    interval: int | float = 1.0,
    *,
    keys: tuple[str, ...] = ("key",),
    ts: str = "ts",
    tie: str = "call_id",
) -> DataFrame:
    """Adds ``call_no`` (1-based within the key) and ``admit``, the time each call
    is let through, in the unit of ``ts``
    and ``interval``; whole numbers (epoch microseconds, say) stay exact.

    Calls without key or time are not counted; their ``call_no`` and ``admit`` are null.
    """
    d = F.lit(interval).cast("bigint" if isinstance(interval, int) else "double")
    names = list(keys)
    known = all_true([F.col(c).isNotNull() for c in (*names, ts)])
    blocked = in_blocks(calls.filter(known), names, [ts, tie])
    ordered = Window.partitionBy(*names, "_block").orderBy(ts, tie)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.withColumn("_j", F.row_number().over(ordered)).withColumn(
        "_m", F.max(F.col(ts) - F.col("_j") * d).over(running)
    )
    blocks = local.groupBy(*names, "_block").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
        .withColumn("_reach", F.max(F.col("_top") - F.col("_before") * d).over(earlier))
        .select(*names, "_block", "_before", "_reach")
    )
    own = F.col("_m") - F.col("_before") * d
    admitted = (
        local.join(offsets, [*names, "_block"])
        .withColumn("call_no", F.col("_before") + F.col("_j"))
        .withColumn("admit", F.greatest(own, F.col("_reach")) + F.col("call_no") * d)
        .drop("_block", "_j", "_m", "_before", "_reach")
    )
    nothing = {c: F.lit(None).cast(admitted.schema[c].dataType) for c in ("call_no", "admit")}
    return admitted.unionByName(calls.filter(~known).withColumns(nothing))
