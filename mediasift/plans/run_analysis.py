"""Requests to results: validate, verify files, reuse, analyse, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.hashing import Engines, cache_key, content_hash
from ..operators.audit import CONTEXT, audit_rows
from ..operators.cache import cache_lookup, join_known, mark_first
from ..operators.contracts import POST_CHARS, validate_analysis_requests
from ..operators.manifest import MB, explode_artifacts, first_error, verify_manifest
from ..schemas import ANALYSIS, REQUEST
from ..session import cut
from ..sources.cache_log import CacheView
from .analyze import analyze_content

# Order of the fields in the hashed form of a request.
INPUT_FIELDS = (
    "artifacts", "post_text", "source_url", "language_hint", "generate_summary", "generate_tags",
    "run_ocr", "transcribe_audio", "run_vision_model", "max_video_duration_seconds",
    "max_keyframes", "max_total_size_mb", "force_reanalyze",
)


@dataclass(frozen=True)
class ToolName:
    name: str = "analyze_content"
    version: str = "1.0.0"


def input_hash() -> Column:
    return content_hash(F.struct(*INPUT_FIELDS))


def check_requests(
    requests: DataFrame, files: DataFrame, root: str, version: str, post_chars: int | None = POST_CHARS
) -> DataFrame:
    """request_id, context, force_reanalyze, input_hash, cache_key, error_code and message; null codes mark requests that may run.

    Both hashes are taken where the rows are, so that no text goes through the exchanges. The file check works on
    the exploded manifest (one exchange by path, one by request) and comes back as one row per request.
    """
    checked = validate_analysis_requests(requests, post_chars)
    valid = checked.filter(F.size("violations") == 0)
    manifest = first_error(
        verify_manifest(
            explode_artifacts(valid).select(
                "request_id", "artifact_index", "path", "size_bytes", "sha256"
            ),
            files, root,
        )
    )
    request = {n: F.col(n) for n in REQUEST.fieldNames() if n in checked.columns}
    context = [c for c in CONTEXT if c in requests.columns]
    small = checked.select(
        "request_id", *context, "force_reanalyze", "violations", "max_total_size_mb",
        input_hash().alias("input_hash"), cache_key(request, version).alias("cache_key"),
    )
    over = F.col("total_size") > F.col("max_total_size_mb") * MB
    return (
        small.join(manifest, "request_id", "left")
        .withColumns(
            {
                "error_code": F.when(F.size("violations") > 0, "invalid_request")
                .when(F.col("first").isNotNull(), F.col("first.code"))
                .when(over, "limit_exceeded"),
                "message": F.when(F.size("violations") > 0, F.array_join("violations", ","))
                .when(F.col("first").isNotNull(), F.col("first.message"))
                .when(over, fixed.MSG_TOTAL_SIZE),
            }
        )
        .withColumn("cache_key", F.when(F.col("error_code").isNull(), F.col("cache_key")))
        .select("request_id", *context, "input_hash", "cache_key", "force_reanalyze", "error_code", "message")
    )


Cache = DataFrame | CacheView


def stored_for(cache: Cache, keys: DataFrame) -> DataFrame:
    """Entries (cache_key, output) that may answer ``keys``: a table as it is, of a log only what can hold one of them."""
    return cache.entries(keys) if isinstance(cache, CacheView) else cache


def decide(
    requests: DataFrame, files: DataFrame, cache: Cache | None, *, root: str, version: str, post_chars: int | None = POST_CHARS
) -> DataFrame:
    """What happens to each request, without its texts: context, input_hash,
    cache_key, work_key, error_code, message, hit, computes.

    ``work_key`` names the computation a request takes its result from: the
    cache key, or the request itself when it is forced.
    """
    small = check_requests(requests, files, root, version, post_chars)
    if cache is None:
        looked = small.withColumn("hit", F.lit(False))
    else:
        # Keys alone, computed once: which runs of a log are read depends on them, and so do all that follow.
        small = cut(small)
        known = stored_for(cache, small.select("cache_key")).select("cache_key", F.lit(True).alias("output"))
        looked = cache_lookup(small, known).withColumn("hit", F.coalesce("cached", F.lit(False))).drop("cached")
    looked = cut(
        looked.withColumn(
            "work_key",
            F.when(F.col("error_code").isNull() & ~F.col("hit"),
                   F.when(F.col("force_reanalyze"), F.concat(F.lit("request-"), F.col("request_id").cast("string")))
                   .otherwise(F.col("cache_key"))),
        )
    )
    # All consumers read the finished decisions; the first request of a key is found once.
    return cut(mark_first(looked))


def run_analysis(
    requests: DataFrame,
    files: DataFrame,
    observations: DataFrame,
    *,
    root: str,
    cache: Cache | None = None,
    replies: DataFrame | None = None,
    engines: Engines = Engines(),
    post_chars: int | None = POST_CHARS,
) -> DataFrame:
    """One row per request: request_id, context, input_hash, cache_key, output,
    error_code, message, computed (whether this request ran the analysis).

    A post over ``post_chars`` breaks the contract; without that limit it fails in the analysis, as any over 10,000 does.

    The decisions are a narrow table computed once; request texts are read for
    the keys and then only for the requests that compute.
    """
    decisions = decide(requests, files, cache, root=root, version=engines.version, post_chars=post_chars)
    computing = decisions.filter("computes").select("request_id", "work_key")
    work = validate_analysis_requests(requests, post_chars).drop("violations").join(computing, "request_id")
    # With many hits, or a small batch, most of the other inputs is not needed:
    # a small id list is broadcast and cuts them before they are shuffled.
    ids = computing.select("request_id")
    observed = observations.join(ids, "request_id", "left_semi")
    answered = replies.join(ids, "request_id", "left_semi") if replies is not None else None
    known = analyze_content(work, observed, answered, engines, keep=("work_key",)).select(
        F.col("work_key").alias("known_key"), "output", F.col("error_code").alias("new_code"), F.col("message").alias("new_message")
    )
    if cache is not None:
        # Outputs are fetched for hits only. A key that hits is not computed, so hits and results go through one join.
        hits = decisions.filter("hit").select("cache_key").distinct()
        stored = stored_for(cache, hits).join(hits, "cache_key", "left_semi")
        nothing = F.lit(None).cast("string")
        known = known.unionByName(
            stored.select(F.col("cache_key").alias("known_key"), "output", nothing.alias("new_code"), nothing.alias("new_message"))
        )
    asked = decisions.withColumn("known_key", F.coalesce("work_key", F.when(F.col("hit"), F.col("cache_key"))))
    joined = join_known(asked, known, "known_key")
    # A hit, also on a result of this very batch, changes the stored output in one flag only.
    output = F.when(F.col("computes"), F.col("output")).otherwise(F.col("output").withField("cache_hit", F.lit(True)))
    context = [c for c in CONTEXT if c in requests.columns]
    return joined.select(
        "request_id", *context, "input_hash", "cache_key",
        output.alias("output"),
        F.coalesce("error_code", "new_code").alias("error_code"),
        F.coalesce("message", "new_message").alias("message"),
        F.col("computes").alias("computed"),
    )


def analysis_audit(results: DataFrame, tool: ToolName = ToolName(), created_at: Column | None = None) -> DataFrame:
    outcomes = results.withColumn("output_hash", content_hash(F.col("output")))
    return audit_rows(
        outcomes, tool_name=tool.name, tool_version=tool.version, created_at=created_at
    )


def cache_puts(results: DataFrame) -> DataFrame:
    """Rows to add to the cache table: freshly computed outputs only."""
    return results.filter(F.col("computed") & F.col("output").isNotNull()).select("cache_key", "output")
