"""Running state over long groups, in two levels.

A window partitioned by the group key alone puts a whole group into one task.
Here the rows are dealt into ranges of their key and order, about equally
many in each, and a range is a block: a (group, block) is a window of its own, the block
summaries (one row each) are scanned per group, and every row combines its
block's offset with its position inside the block. A group that fits into one range has one summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_block``, which grows with the order inside a group.

    Ranges follow the rows, not the values: an outlier makes no block large. The
    rows are written once, so that all that reads them sees the same blocks.
    """
    return cut(df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))


def block_offsets(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (group, block): ``_n`` rows, ``_before`` of them in earlier blocks, ``group_size`` in the group."""
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")),
            "group_size": F.sum("_n").over(Window.partitionBy(*keys)),
        }
    )
