"""Keyword tables: long forms of the row-local keyword functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import fixed
from ..functions.text import keyword_counts, keywords, top_keywords


def keyword_count_rows(posts: DataFrame, text: str = "text") -> DataFrame:
    """request_id, word, n, first_pos for texts that are one row each; nothing is shuffled."""
    return posts.select("request_id", F.explode(keyword_counts(text)).alias("k")).select(
        "request_id", F.col("k.word").alias("word"), F.col("k.n").alias("n"), F.col("k.pos").alias("first_pos")
    )


def keyword_rows(posts: DataFrame, text: str = "text", maximum: int = fixed.TOPICS) -> DataFrame:
    """request_id, rank, word, n: the best words of each row's text; nothing is shuffled."""
    ranked = top_keywords(keyword_counts(text), maximum)
    return posts.select("request_id", F.posexplode(ranked).alias("i", "k")).select(
        "request_id", (F.col("i") + 1).alias("rank"), F.col("k.word").alias("word"), F.col("k.n").alias("n")
    )


def keyword_arrays(posts: DataFrame, text: str = "text", maximum: int = fixed.TOPICS) -> DataFrame:
    return posts.select("request_id", keywords(text, maximum).alias("topics"))


def top_words_of_parts(parts: DataFrame, maximum: int = fixed.TOPICS) -> DataFrame:
    """Best words of requests whose text is spread over many rows.

    ``parts``: request_id, part_no (below 2^31), text. Each part is counted in its row; the
    partial counts add up in a hash aggregate that combines before the shuffle,
    so a request with very many parts is spread over all tasks, and the rank
    filter keeps ``maximum`` rows per task before the last exchange.
    """
    # Latin words come before CJK words whatever their part.
    counted = parts.select(
        "request_id", "part_no", F.explode(keyword_counts("text")).alias("k")
    ).select(
        "request_id",
        F.col("k.word").alias("word"),
        F.col("k.n").cast("bigint").alias("n"),
        # Script, part and place packed into one number: a hash aggregate can hold it.
        (
            F.shiftleft(F.col("k.word").rlike(f"[{fixed.CJK}]").cast("bigint"), 62)
            + F.shiftleft(F.col("part_no").cast("bigint"), 31)
            + F.col("k.pos")
        ).alias("first"),
    )
    totals = counted.groupBy("request_id", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    window = Window.partitionBy("request_id").orderBy(F.desc("n"), "first")
    return (
        totals.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= maximum)
        .select("request_id", "rank", "word", "n")
    )


def stop_words(spark: SparkSession) -> DataFrame:
    """The 16 fixed stop words, one per row."""
    return spark.createDataFrame([(w,) for w in fixed.STOP_WORDS], "word string")


def without_stop_words(tokens: DataFrame) -> DataFrame:
    """Anti join with the fixed list (16 rows, broadcast)."""
    return tokens.join(F.broadcast(stop_words(tokens.sparkSession)), "word", "left_anti")
