"""The platform catalog and the domain allowlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.core import col


def platform_catalog(spark: SparkSession) -> DataFrame:
    """One row per domain: domain, platform, display_name, extractor, content_types, support_level."""
    rows = [
        (domain, key, name, extractor, list(types), level)
        for key, name, domains, extractor, types, level in fixed.PLATFORMS
        for domain in domains
    ]
    return spark.createDataFrame(
        rows,
        "domain string, platform string, display_name string, extractor string,"
        "content_types array<string>, support_level string",
    )


def default_domains() -> list[str]:
    return sorted(d for platform in fixed.PLATFORMS for d in platform[2])


def allowed_domains(configured: DataFrame, text: str = "domains") -> DataFrame:
    """Distinct domains of comma-separated lists: lower case, trimmed, no leading dots, no blanks."""
    items = F.explode(F.split(col(text), ","))
    clean = F.ltrim(F.trim(F.lower(F.col("item"))), F.lit("."))
    return (
        configured.select(items.alias("item"))
        .filter(F.trim("item") != "")
        .select(clean.alias("domain"))
        .distinct()
    )
