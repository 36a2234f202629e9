"""JSON readers: closed-schema requests, raw site records of unknown shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.core import col, empty_array
from ..schemas import ARTIFACT, DOWNLOAD_REQUEST, REQUEST


def unknown_keys(raw: Column, known: list[str]) -> Column:
    keys = F.json_object_keys(raw)
    return F.array_except(F.coalesce(keys, empty_array("string")), F.array(*[F.lit(k) for k in known]))


def read_requests(lines: DataFrame, schema: T.StructType = REQUEST, raw: str = "value") -> DataFrame:
    """Parsed columns plus ``unknown_keys`` and ``malformed``.

    Unknown keys, also inside artifacts, are errors: a line is usable when it
    is well formed and ``unknown_keys`` is empty.
    """
    line = col(raw)
    corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        line, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    nested = F.from_json(F.get_json_object(line, "$.artifacts"), "array<string>")
    inner = F.flatten(
        F.transform(F.coalesce(nested, empty_array("string")), lambda a: unknown_keys(a, ARTIFACT.fieldNames()))
    )
    found = F.concat(unknown_keys(line, schema.fieldNames()), inner)
    return lines.select(
        parsed.alias("p"),
        F.array_distinct(found).alias("unknown_keys"),
        line.alias("_line"),
    ).select(
        "p.*", "unknown_keys", F.json_object_keys("_line").isNull().alias("_not_object")
    ).withColumn(
        "malformed", F.col("_not_object") | F.col("_corrupt").isNotNull()
    ).drop("_not_object", "_corrupt")


def read_download_requests(lines: DataFrame, raw: str = "value") -> DataFrame:
    return read_requests(lines, DOWNLOAD_REQUEST, raw)


def read_raw_info(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw site records as VARIANT in ``record``; unreadable lines become null."""
    return lines.withColumn("record", F.try_parse_json(raw)).drop(raw)
