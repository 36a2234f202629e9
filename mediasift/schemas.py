"""Explicit schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOL = T.DoubleType(), T.BooleanType()
DATE, TIMESTAMP = T.DateType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])

ARTIFACT = _struct(
    path=STRING, size_bytes=LONG, sha256=STRING, media_type=STRING,
)

REQUEST = _struct(
    request_id=LONG, tenant_id=STRING, trace_id=STRING, workflow_run_id=STRING, agent_run_id=STRING,
    actor_type=STRING, actor_id=STRING, post_text=STRING, source_url=STRING, language_hint=STRING,
    generate_summary=BOOL, generate_tags=BOOL, run_ocr=BOOL, transcribe_audio=BOOL,
    run_vision_model=BOOL, max_video_duration_seconds=LONG, max_keyframes=LONG,
    max_total_size_mb=LONG, force_reanalyze=BOOL, artifacts=T.ArrayType(ARTIFACT),
)
# Values a request takes where it says nothing.
REQUEST_DEFAULTS = {
    "generate_summary": True,
    "generate_tags": True,
    "run_ocr": True,
    "transcribe_audio": True,
    "run_vision_model": True,
    "max_video_duration_seconds": 3600,
    "max_keyframes": 24,
    "max_total_size_mb": 2000,
    "force_reanalyze": False,
}

DOWNLOAD_REQUEST = _struct(
    request_id=LONG, tenant_id=STRING, trace_id=STRING, workflow_run_id=STRING, agent_run_id=STRING,
    actor_type=STRING, actor_id=STRING, urls=STRINGS, mode=STRING, media_format=STRING,
    include_playlists=BOOL, max_items=LONG, max_file_size_mb=LONG, max_total_size_mb=LONG,
    max_duration_seconds=LONG, request_timeout_seconds=DOUBLE, write_thumbnail=BOOL,
    write_subtitles=BOOL, browser_cookie_source=STRING,
)
DOWNLOAD_DEFAULTS = {
    "mode": "download",
    "media_format": "best",
    "include_playlists": False,
    "max_items": 20,
    "max_file_size_mb": 500,
    "max_total_size_mb": 1000,
    "max_duration_seconds": 3600,
    "request_timeout_seconds": 30.0,
    "write_thumbnail": False,
    "write_subtitles": False,
    "browser_cookie_source": "none",
}

SEGMENT = _struct(
    start_seconds=DOUBLE, end_seconds=DOUBLE, text=STRING,
)

# What the extraction stage found in one artifact: one row per artifact, so
# that lines and segments stay ordered arrays and numbering needs no shuffle.
OBSERVATION = _struct(
    artifact_index=INT, decodable=BOOL, width=LONG, height=LONG, duration_seconds=DOUBLE,
    perceptual_hash=STRING, sampled_frame_count=INT, has_audio=BOOL, ocr_lines=STRINGS,
    ocr_error=STRING, segments=T.ArrayType(SEGMENT), asr_error=STRING, frame_warning=STRING,
)

EVIDENCE = _struct(
    evidence_id=STRING, kind=STRING, artifact_sha256=STRING, text=STRING, timestamp_seconds=DOUBLE,
    confidence=DOUBLE,
)
TAG = _struct(
    namespace=STRING, label=STRING, confidence=DOUBLE, evidence_refs=STRINGS,
)

SEMANTIC = _struct(
    language=STRING, summary=STRING, topics=STRINGS, entities=STRINGS, claims=STRINGS,
    image_summary=STRING, video_summary=STRING, transcript_summary=STRING, sentiment=STRING,
    commercial_intent=STRING, safety_flags=STRINGS, confidence=DOUBLE, evidence_refs=STRINGS,
)

ASSET = _struct(
    artifact_sha256=STRING, media_type=STRING, modality=STRING, width=LONG, height=LONG,
    duration_seconds=DOUBLE, perceptual_hash=STRING, ocr_text=STRINGS,
    transcript=T.ArrayType(SEGMENT), sampled_frame_count=INT, warnings=STRINGS,
)

ANALYSIS = _struct(
    language=STRING, summary=STRING, tags=T.ArrayType(TAG), topics=STRINGS, entities=STRINGS,
    claims=STRINGS, image_summary=STRING, video_summary=STRING, transcript_summary=STRING,
    sentiment=STRING, commercial_intent=STRING, safety_flags=STRINGS, confidence=DOUBLE,
    evidence=T.ArrayType(EVIDENCE), needs_human_review=BOOL, assets=T.ArrayType(ASSET),
    warnings=STRINGS, cache_hit=BOOL, pipeline_version=STRING,
    model_versions=T.MapType(STRING, STRING),
)

MEDIA_INFO = _struct(
    source_url=STRING, webpage_url=STRING, extractor=STRING, media_id=STRING, title=STRING,
    description=STRING, uploader=STRING, uploader_id=STRING, upload_date=DATE,
    duration_seconds=DOUBLE, thumbnail_url=STRING, view_count=LONG, like_count=LONG,
    repost_count=LONG, comment_count=LONG,
)

AUDIT = _struct(
    tenant_id=STRING, trace_id=STRING, workflow_run_id=STRING, agent_run_id=STRING,
    actor_type=STRING, actor_id=STRING, event_type=STRING, tool_name=STRING, tool_version=STRING,
    input_hash=STRING, output_hash=STRING, error_code=STRING, created_at=TIMESTAMP,
)
