"""Guarded casts of untrusted VARIANT values and of free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import col, nonempty
from .urls import http_url


def field(record: Column, name: str) -> Column:
    """One top-level field of a VARIANT record, as VARIANT."""
    return F.try_variant_get(record, f"$.{name}", "variant")


def variant_type(value: Column) -> Column:
    """Type name of a VARIANT scalar, e.g. STRING, BIGINT, BOOLEAN; null when absent."""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(variant_type(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    """JSON numbers and booleans; a numeric string is no number."""
    return F.coalesce(variant_type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.lit(False))


def text(value: Column, limit: int) -> Column:
    return F.when(
        is_string(value), F.left(nonempty(F.try_variant_get(value, "$", "string")), F.lit(limit))
    )


def any_text(value: Column) -> Column:
    """Text form of a truthy scalar, else null."""
    kind = variant_type(value)
    as_text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.when(as_text == "true", "True"))
        .when(is_number(value), F.when(F.try_variant_get(value, "$", "double") != 0, as_text))
        .otherwise(nonempty(as_text))
    )


def number(value: Column) -> Column:
    return F.when(
        variant_type(value) == "BOOLEAN",
        F.try_variant_get(value, "$", "boolean").cast("int").cast("double"),
    ).when(is_number(value), F.try_variant_get(value, "$", "double"))


def integer(value: Column) -> Column:
    return F.when(
        variant_type(value) == "BOOLEAN",
        F.try_variant_get(value, "$", "boolean").cast("int").cast("bigint"),
    ).when(is_number(value), F.try_variant_get(value, "$", "bigint"))


def web_address(value: Column) -> Column:
    return F.when(is_string(value), http_url(F.try_variant_get(value, "$", "string")))


def upload_date(value: Column) -> Column:
    """yyyymmdd strings of eight digits only; anything else is null."""
    raw = F.when(is_string(value), F.try_variant_get(value, "$", "string"))
    return F.when(raw.rlike("^[0-9]{8}$"), F.try_to_date(raw, "yyyyMMdd"))


def nonneg_float(value: Column | str) -> Column:
    parsed = F.trim(col(value)).try_cast("double")
    return F.when((parsed >= 0) & ~F.isnan(parsed), parsed)


def positive_int(value: Column | str) -> Column:
    parsed = F.trim(col(value)).try_cast("bigint")
    return F.when(parsed > 0, parsed)
