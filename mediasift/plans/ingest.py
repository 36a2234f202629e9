"""Download requests and raw site records to normalized items."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import text_array
from ..functions.errors import classified
from ..functions.hashing import content_hash
from ..functions.urls import http_url, normalize_video_url, throttle_host
from ..operators.audit import CONTEXT, audit_rows
from ..operators.contracts import validate_download_requests
from ..operators.manifest import size_limits
from ..operators.policy import resolved_hosts, url_policy
from ..operators.records import cap_items, flatten_entries, normalize_media_info, record_duration_ok
from ..operators.throttle import throttle_schedule
from ..schemas import MEDIA_INFO
from ..session import cut

BUCKET = "public-read"
INPUT_FIELDS = (
    "urls", "mode", "media_format", "include_playlists", "max_items", "max_file_size_mb",
    "max_total_size_mb", "max_duration_seconds", "request_timeout_seconds", "write_thumbnail",
    "write_subtitles", "browser_cookie_source",
)


def explode_urls(requests: DataFrame, *keep: str) -> DataFrame:
    """One row per address with its 1-based index and the form extractors know."""
    return requests.select("request_id", *keep, F.posexplode("urls").alias("pos", "url")).select(
        "request_id", *keep, (F.col("pos") + 1).alias("url_index"), "url",
        normalize_video_url("url").alias("extractor_url"),
    )


def url_verdicts(
    requests: DataFrame, dns: DataFrame, allowed: DataFrame | Iterable[str], networks: DataFrame | None = None
) -> DataFrame:
    """request_id, refused: the code of the first refused address, null when none is."""
    urls = url_policy(explode_urls(requests), allowed).withColumnRenamed("error_code", "url_code")
    judged = urls.join(resolved_hosts(dns, networks), "host", "left")
    unresolved = F.coalesce(F.col("n_addresses"), F.lit(0)) == 0
    # First address, then its code, packed into one number for a hash aggregate.
    rank = (
        F.when(F.col("url_code") == "unsafe_url", 1)
        .when(F.col("url_code") == "permission_denied", 2)
        .when(unresolved, 3)
        .when(F.col("any_bad"), 4)
    )
    codes = text_array(("unsafe_url", "permission_denied", "platform_unavailable", "unsafe_url"))
    place = F.col("_place")
    return (
        judged.groupBy("request_id")
        .agg(F.min(F.col("url_index").cast("bigint") * 10 + rank).alias("_place"))
        .select("request_id", F.get(codes, (place % 10).cast("int") - 1).alias("refused"))
    )


def check_downloads(
    requests: DataFrame, dns: DataFrame, allowed: DataFrame | Iterable[str], networks: DataFrame | None = None
) -> DataFrame:
    checked = validate_download_requests(requests).withColumn(
        "input_hash", content_hash(F.struct(*INPUT_FIELDS), keep_nulls=False)
    )
    valid = checked.filter(F.size("violations") == 0)
    return (
        checked.join(url_verdicts(valid, dns, allowed, networks), "request_id", "left")
        .withColumn(
            "error_code",
            F.when(F.size("violations") > 0, "invalid_request").otherwise(F.col("refused")),
        )
        .drop("violations", "refused")
    )


def admissions(requests: DataFrame, interval: int | float, ts: str = "ts") -> DataFrame:
    """request_id, admit: throttled per tenant and host of the first address."""
    calls = requests.select(
        "request_id",
        F.concat_ws(":", "tenant_id", F.lit(BUCKET), throttle_host(F.get("urls", F.lit(0)))).alias("key"),
        F.col(ts).alias("ts"),
    )
    return throttle_schedule(calls, interval, keys=("key",), ts="ts", tie="request_id").select(
        "request_id", "admit"
    )


def media_items(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Normalized items of accepted requests.

    ``raw``: request_id, url_index, source_url, record (VARIANT). Flattened
    depth first, cut to ``max_items`` in address order, over-long media dropped.
    """
    wanted = requests.select("request_id", "max_items", "max_duration_seconds")
    # Only records that are asked for are parsed and opened; the key alone may pass below what makes them.
    asked = raw.join(wanted.select("request_id"), "request_id", "left_semi").join(wanted, "request_id")
    flat = flatten_entries(asked).filter(F.col("record").isNotNull())
    kept = cap_items(
        flat.filter(record_duration_ok(F.col("record"), F.col("max_duration_seconds"))),
        F.col("max_items"), "url_index", "path",
    )
    columns = normalize_media_info(F.col("record"), F.col("source_url"))
    return kept.select(
        "request_id", "item_no",
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in MEDIA_INFO.fields],
    )


def fetch_errors(failures: DataFrame | None, accepted: DataFrame) -> DataFrame:
    """request_id, fetch_code and message of accepted requests that the fetcher failed on."""
    if failures is None:
        return accepted.select("request_id", *(F.lit(None).cast("string").alias(c) for c in ("fetch_code", "message"))).limit(0)
    told = failures.filter(F.col("error").isNotNull()).groupBy("request_id").agg(F.min("error").alias("error"))
    found = told.join(accepted.select("request_id"), "request_id", "left_semi").select("request_id", classified("error").alias("found"))
    return found.select("request_id", F.col("found.code").alias("fetch_code"), F.col("found.shown").alias("message"))


def artifact_digests(artifacts: DataFrame) -> DataFrame:
    """request_id and a hash of its artifacts in no order: sums of two hashes of fixed width, however many there are."""
    columns = [c for c in ("path", "size_bytes", "sha256", "media_type") if c in artifacts.columns]
    sums = [F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(20,0)")).cast("string") for i in (0, 1)]
    return artifacts.groupBy("request_id").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("artifacts_hash"))


def ingest_media(
    requests: DataFrame,
    raw: DataFrame,
    artifacts: DataFrame,
    dns: DataFrame,
    allowed: DataFrame | Iterable[str],
    *,
    networks: DataFrame | None = None,
    failures: DataFrame | None = None,
    interval: int | float | None = None,
    ts: str = "ts",
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, items): one outcome per request with its error_code, and the
    items of requests that succeeded. With ``interval`` outcomes have ``admit``,
    the time each accepted request is let through.

    ``failures`` (request_id, error): what the fetcher said of requests that it gave up; of several the least text counts.
    Per-request failures: broken contract, refused address, fetch failure, size limits, then a
    record without a usable source address, which fails the whole request. ``message`` is what a fetch failure shows.
    """
    # The narrow decision tables feed several branches and the items two: each is
    # computed once.
    checked = cut(check_downloads(requests, dns, allowed, networks))
    accepted = checked.filter(F.col("error_code").isNull())
    limits = size_limits(
        artifacts.join(
            accepted.select("request_id", "max_file_size_mb", "max_total_size_mb"), "request_id"
        ),
        file_cap_mb=F.col("max_file_size_mb"),
        total_cap_mb=F.col("max_total_size_mb"),
    ).select("request_id", F.col("error_code").alias("limit_code"))
    # What fails before its records are read has no items, so these are opened for the others only.
    judged = cut(
        checked.join(limits, "request_id", "left")
        .join(fetch_errors(failures, accepted), "request_id", "left")
        .withColumn("error_code", F.coalesce("error_code", "fetch_code", "limit_code"))
        .drop("limit_code", "fetch_code")
    )
    items = cut(media_items(judged.filter(F.col("error_code").isNull()), raw))
    per_request = items.groupBy("request_id").agg(
        F.bool_or(http_url(F.col("source_url")).isNull()).alias("bad_item"), F.count("*").alias("n_items"),
        # No more items than the request's cap allows.
        F.sort_array(F.collect_list(F.struct("item_no", content_hash(F.struct(*MEDIA_INFO.fieldNames())).alias("h")))).alias("hashes"),
    )
    outcomes = (
        judged.join(artifact_digests(artifacts), "request_id", "left")
        .join(per_request, "request_id", "left")
        .withColumn("error_code", F.coalesce("error_code", F.when(F.col("bad_item"), "download_failed")))
        .withColumn("n_items", F.when(F.col("error_code").isNull(), F.coalesce("n_items", F.lit(0))))
        .withColumn("items_hash", F.sha2(F.array_join(F.transform("hashes", lambda x: x["h"]), ","), 256))
        .drop("bad_item", "hashes")
    )
    if interval is not None:
        outcomes = outcomes.join(admissions(accepted, interval, ts), "request_id", "left")
    good = outcomes.filter(F.col("error_code").isNull()).select("request_id")
    return outcomes, items.join(good, "request_id", "left_semi")


def download_audit(
    outcomes: DataFrame, *, tool_name: str = "download_media", tool_version: str = "1.5.0",
    created_at: Column | None = None,
) -> DataFrame:
    """One audit row per request; the output hash covers its items and artifacts."""
    context = [c for c in CONTEXT if c in outcomes.columns]
    hashed = outcomes.select(
        *context, "input_hash", "error_code",
        F.sha2(F.concat_ws("|", "input_hash", F.col("n_items").cast("string"), "items_hash", F.coalesce("artifacts_hash", F.lit(""))), 256).alias("output_hash"),
    )
    return audit_rows(hashed, tool_name=tool_name, tool_version=tool_version, created_at=created_at)
