"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import work_dir

# Words of a text: maximal runs without blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    It cuts the lineage in a way that survives lost executors, and gives the
    planner the true size of what follows. The table stays until the folder is cleared.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_key(source: Column) -> Column:
    """A text that is never null; keeps code-point order and puts null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def part_bases(rows: DataFrame, size: str, keys: list[str]) -> DataFrame:
    """Where each written part begins: (part, *keys, base), the sum of ``size`` over
    all earlier parts with the same keys.

    ``rows`` has been written with the column ``part``. One row per part and key
    takes part, never the rows themselves.
    """
    sums = rows.groupBy("part", *keys).agg(F.sum(size).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("base"))


def hashed_sample(rows: DataFrame, about: int, *keys: str) -> DataFrame:
    """About so many of the rows, or all if there are not more; which ones follows from a hash of ``keys``.

    A filter, so that nothing gathers but what is sampled.
    """
    n = rows.count()
    if n <= about:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(about / n * (1 << 40)))


def levelled_sample(rows: DataFrame, about: int, label: str, *keys: str) -> DataFrame:
    """About so many of the rows, or all if there are not more, shared evenly among the values of ``label``.

    A value with fewer rows than its share gives all of them, and what it leaves goes to
    the others. Each value gives one row at least. Which ones follows from a hash of
    ``keys``. One count for each value comes to the driver.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    left, bounds = about, []
    for i, r in enumerate(sorted(found, key=lambda r: (r["n"], r[label]))):
        share = left / (len(found) - i)
        if r["n"] > share:
            bounds.append((r[label], max(int(share / r["n"] * (1 << 40)), r["first"] + 1)))
        left -= min(r["n"], share)
    if not bounds:
        return rows
    limits = F.broadcast(rows.sparkSession.createDataFrame(bounds, f"`{label}` string, _limit long"))
    kept = rows.join(limits, label, "left").filter(F.col("_limit").isNull() | (place < F.col("_limit")))
    return kept.drop("_limit")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of every labelled id. A document with several labels
    counts as 1 if any is 1; null ids, null labels and other values are left out.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias(label))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and label of about ``rows`` labelled documents of each label value 0 and 1.

    Which ones follows from a hash of the id; of labels those of ``known_labels`` count.
    """
    known = known_labels(labels, label)
    chosen = [hashed_sample(known.filter(F.col(label) == value), rows, "doc_id") for value in (0, 1)]
    # About 2 * rows ids, whatever the input's size.
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id")
    # One text for each id, however many documents share it.
    return texts.groupBy("doc_id", label).agg(F.min("text").alias("text"))
