"""Even samples of ordered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.media import evenly_sample, sample_indices, uniform_timestamps
from ..session import cut
from .blocks import block_offsets, in_blocks

MAX_IMAGES = 16


def evenly_sample_rows(
    rows: DataFrame, keys: list[str], order: list[str], maximum: int
) -> DataFrame:
    """At most ``maximum`` rows per group at even places; ``sample_no`` counts from 0.

    Order statistics by counting: the sizes of the blocks say which block holds each place and where in it, one
    row a place. Only blocks that hold one are numbered; the rows of all others go no further, and a
    very long group is never sorted in one task. A place that is picked twice comes out twice.
    """
    blocked = in_blocks(rows, keys, order)
    low, high = F.col("_before"), F.col("_before") + F.col("_n")
    # Below the cap every row is kept; its place is its sample number.
    every = F.transform(F.sequence(low, high - 1), lambda v: F.struct(v.cast("int").alias("sample_no"), (v - low + 1).alias("_local")))
    even = F.filter(
        F.transform(
            sample_indices(F.col("group_size"), maximum),
            lambda v, i: F.struct(i.cast("int").alias("sample_no"), (v.cast("bigint") - low + 1).alias("_local")),
        ),
        lambda s: (s["_local"] >= 1) & (s["_local"] <= F.col("_n")),
    )
    offsets = block_offsets(blocked, keys)
    picks = cut(offsets.select(*keys, "_block", F.inline(F.when(F.col("group_size") <= maximum, every).otherwise(even))))
    held = blocked.join(picks.select(*keys, "_block").distinct(), [*keys, "_block"], "left_semi")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    numbered = held.withColumn("_local", F.row_number().over(inside).cast("bigint"))
    return numbered.join(picks, [*keys, "_block", "_local"]).select(*rows.columns, "sample_no")


def limit_images(images: Column, maximum: int = MAX_IMAGES) -> Column:
    """Even sample of a request's image list for one model call."""
    return evenly_sample(images, maximum)


def uniform_timestamp_rows(media: DataFrame, duration: str, maximum: int, *keep: str) -> DataFrame:
    return media.select(
        *keep, F.posexplode(uniform_timestamps(duration, maximum)).alias("n", "timestamp_seconds")
    )
