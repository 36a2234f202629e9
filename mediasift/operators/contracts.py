"""Contract rules. A broken rule makes a row of ``failures``, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import fits, nonempty, strip
from ..functions.urls import has_credentials, http_url, url_scheme
from ..schemas import DOWNLOAD_DEFAULTS, REQUEST_DEFAULTS

Rules = dict[str, Column]

SEGMENT_CHARS = 20_000
POST_CHARS = 100_000


def broken(rules: Rules) -> Column:
    """Names of the rules that do not hold, in order; a null result counts as broken."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]
    return F.filter(F.array(*marks), lambda name: name.isNotNull())


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )


def _length(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def _optional(value: Column, rule: Column) -> Column:
    return value.isNull() | rule


def analysis_rules(post_chars: int | None = POST_CHARS) -> Rules:
    """Rules of a request; without ``post_chars`` a post may be of any length."""
    artifacts, hint, text = F.col("artifacts"), F.col("language_hint"), F.col("post_text")
    return {
        "artifacts": F.size(artifacts).between(1, 100),
        "artifact_path": F.forall(artifacts, lambda a: _length(a["path"], 1, 4096)),
        "artifact_size": F.forall(artifacts, lambda a: a["size_bytes"] >= 0),
        "artifact_sha256": F.forall(
            artifacts,
            lambda a: (F.length(a["sha256"]) == 64) & a["sha256"].rlike("^[0-9a-fA-F]{64}$"),
        ),
        "artifact_media_type": F.forall(
            artifacts, lambda a: _optional(a["media_type"], F.length(a["media_type"]) <= 255)
        ),
        "post_text": F.lit(True) if post_chars is None else _optional(text, fits(text, post_chars)),
        "source_url": _optional(F.col("source_url"), http_url(F.col("source_url")).isNotNull()),
        "language_hint": _optional(hint, F.length(hint) <= 32),
        "max_video_duration_seconds": F.col("max_video_duration_seconds").between(1, 21_600),
        "max_keyframes": F.col("max_keyframes").between(1, 120),
        "max_total_size_mb": F.col("max_total_size_mb").between(1, 10_000),
    }


def validate_analysis_requests(requests: DataFrame, post_chars: int | None = POST_CHARS) -> DataFrame:
    """Adds ``violations``; defaults filled in and the language hint trimmed."""
    filled = with_defaults(requests, REQUEST_DEFAULTS)
    return filled.withColumns(
        {
            "violations": broken(analysis_rules(post_chars)),
            "language_hint": nonempty(strip("language_hint")),
        }
    )


def download_rules() -> Rules:
    urls = F.col("urls")
    return {
        "urls": F.size(urls).between(1, 20),
        "url": F.forall(urls, lambda u: http_url(u).isNotNull()),
        "url_scheme": F.forall(urls, lambda u: url_scheme(u) == "https"),
        "url_credentials": F.forall(urls, lambda u: ~has_credentials(u)),
        "mode": F.col("mode").isin("metadata_only", "download"),
        "media_format": F.col("media_format").isin("best", "video", "audio"),
        "max_items": F.col("max_items").between(1, 100),
        "max_file_size_mb": F.col("max_file_size_mb").between(1, 2_000),
        "max_total_size_mb": F.col("max_total_size_mb").between(1, 5_000),
        "max_duration_seconds": F.col("max_duration_seconds").between(1, 21_600),
        "request_timeout_seconds": F.col("request_timeout_seconds").between(5.0, 120.0),
        "browser_cookie_source": F.col("browser_cookie_source").isin(
            "none", "auto", "chrome", "edge", "firefox", "safari"
        ),
    }


def validate_download_requests(requests: DataFrame) -> DataFrame:
    filled = with_defaults(requests, DOWNLOAD_DEFAULTS)
    return filled.withColumn("violations", broken(download_rules()))


def _all(items: Column, rule) -> Column:
    return F.coalesce(F.forall(items, rule), F.lit(True))


def evidence_ok(evidence: Column) -> Column:
    return _all(
        evidence,
        lambda e: _optional(e["text"], fits(e["text"], 10_000))
        & _optional(e["timestamp_seconds"], e["timestamp_seconds"] >= 0)
        & e["confidence"].between(0.0, 1.0),
    )


def tags_ok(tags: Column) -> Column:
    return _all(
        tags,
        lambda t: _length(t["label"], 1, 200)
        & t["confidence"].between(0.0, 1.0)
        & (F.size(t["evidence_refs"]) <= 50),
    )


def segments_ok(segments: Column) -> Column:
    return _all(
        segments,
        lambda s: _length(s["text"], 1, SEGMENT_CHARS) & (s["start_seconds"] >= 0) & (s["end_seconds"] >= 0),
    )


def sizes_ok(width: Column, height: Column) -> Column:
    return _optional(width, width >= 1) & _optional(height, height >= 1)


def output_rules(evidence: Column, tags: Column, segments: Column, width: Column, height: Column) -> Rules:
    """Caps on outputs that make a whole request fail."""
    return {
        "evidence": evidence_ok(evidence),
        "tags": tags_ok(tags),
        "segments": segments_ok(segments),
        "dimensions": sizes_ok(width, height),
    }
