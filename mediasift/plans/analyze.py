"""Full analysis of a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import empty_array, fits, let, settle, strip, unique_texts
from ..functions.hashing import Engines
from ..functions.media import detect_media, file_name
from ..functions.replies import clamp01, evidence_refs, parse_semantic_payload, review_flag
from ..functions.text import keywords
from ..operators import contracts, evidence as ev
from ..operators.tags import TAG_DDL, dedupe_tags, union_tags
from ..schemas import ANALYSIS, ASSET, OBSERVATION, SEGMENT
from .understand import collapsed_texts, understanding


def group_observations(observations: DataFrame) -> DataFrame:
    """One row per request with the array of its observations: one per artifact
    index, the least where an index repeats. Requests whose artifacts exceed the
    contract are rejected before."""
    fields = F.struct(*OBSERVATION.fieldNames())
    one = observations.groupBy("request_id", "artifact_index").agg(F.min(fields).alias("o"))
    return (
        one.select("request_id", "o.*")
        .groupBy("request_id")
        .agg(F.collect_list(fields).alias("observations"))
    )


def _failure(code: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))


def _asset(artifact: Column, index: Column, engines: Engines) -> Column:
    """Everything about one artifact: asset fields, evidence, first failure."""
    found = F.get(F.filter(F.col("observations"), lambda o: o["artifact_index"] == index), F.lit(0))
    seen = F.struct(
        artifact.alias("a"), found.alias("o"), detect_media(artifact["path"], artifact["media_type"]).alias("m")
    )

    def build(x: Column) -> Column:
        obs, modality = x["o"], x["m"]["modality"]
        is_image, is_video = modality == "image", modality == "video"
        is_av = is_video | (modality == "audio")
        none = empty_array("string")

        ocr_on = F.lit(engines.ocr != fixed.OCR_DISABLED)
        asr_on = F.lit(engines.asr != fixed.ASR_DISABLED)
        reads = F.col("run_ocr") & (is_image | is_video)
        hears = F.col("transcribe_audio") & is_av
        audible = F.coalesce(obs["has_audio"], F.lit(True)) | ~is_video

        lines = F.when(
            reads & ocr_on, unique_texts(F.coalesce(obs["ocr_lines"], none))
        ).otherwise(none)
        # A segment over its limit is a failure of the recognizer: a warning, and no transcript.
        over_long = F.coalesce(
            F.exists(obs["segments"], lambda s: ~fits(s["text"], contracts.SEGMENT_CHARS) & ~fits(strip(s["text"]), contracts.SEGMENT_CHARS)), F.lit(False)
        )
        asr_error = F.coalesce(obs["asr_error"], F.when(over_long, fixed.VALIDATION_ERROR))
        spoken = F.when(
            hears & asr_on & audible & ~over_long,
            F.coalesce(ev.clean_segments(obs["segments"]), empty_array(SEGMENT.simpleString())),
        ).otherwise(empty_array(SEGMENT.simpleString()))

        def warn(test: Column, text: Column | str) -> Column:
            return F.when(test, text)

        ocr_failed = F.when(
            is_image, F.format_string(fixed.WARN_OCR_FAILED.replace("{}", "%s"), obs["ocr_error"])
        ).otherwise(F.format_string(fixed.WARN_FRAME_OCR_FAILED.replace("{}", "%s"), obs["ocr_error"]))
        asr_failed = F.format_string(fixed.WARN_ASR_FAILED.replace("{}", "%s"), asr_error)
        warnings = F.filter(
            F.array(
                warn(modality == "unknown", F.concat(F.lit(fixed.WARN_SKIPPED), file_name(x["a"]["path"]))),
                warn(is_video, obs["frame_warning"]),
                warn(reads & ~ocr_on, fixed.WARN_NO_OCR),
                warn(reads & ocr_on & obs["ocr_error"].isNotNull(), ocr_failed),
                warn(hears & ~asr_on, fixed.WARN_NO_ASR),
                warn(hears & asr_on & ~audible, fixed.WARN_NO_AUDIO),
                warn(hears & asr_on & audible & asr_error.isNotNull(), asr_failed),
            ),
            lambda w: w.isNotNull(),
        )
        sha256 = F.lower(x["a"]["sha256"])
        duration = F.when(is_av & (obs["duration_seconds"] >= 0), obs["duration_seconds"])
        fields = {
            "artifact_sha256": sha256,
            "media_type": x["m"]["media_type"],
            "modality": modality,
            "width": F.when(is_image | is_av, F.when(obs["width"] > 0, obs["width"])),
            "height": F.when(is_image | is_av, F.when(obs["height"] > 0, obs["height"])),
            "duration_seconds": duration,
            "perceptual_hash": F.when(is_image, obs["perceptual_hash"]),
            "ocr_text": lines,
            "transcript": spoken,
            "sampled_frame_count": F.when(is_video, F.coalesce(obs["sampled_frame_count"], F.lit(0))).otherwise(0),
            "warnings": unique_texts(warnings),
        }

        def finish(asset: Column) -> Column:
            own = F.concat(
                ev.ocr_evidence(index, asset["artifact_sha256"], asset["ocr_text"], asset["modality"]),
                ev.transcript_evidence(index, asset["artifact_sha256"], asset["transcript"]),
            )
            usable = F.coalesce(obs["decodable"], F.lit(False))
            failure = (
                F.when(is_image & ~usable, _failure("unsupported_media", fixed.MSG_BAD_IMAGE))
                .when(is_av & ~usable, _failure("unsupported_media", fixed.MSG_BAD_AV))
                .when(
                    duration > F.col("max_video_duration_seconds"),
                    _failure("limit_exceeded", fixed.MSG_TOO_LONG),
                )
                .when(
                    ~contracts.segments_ok(asset["transcript"]),
                    _failure("analysis_failed", fixed.MSG_ANALYSIS_FAILED),
                )
            )

            def checked(items: Column) -> Column:
                bad = F.when(
                    ~contracts.evidence_ok(items), _failure("analysis_failed", fixed.MSG_ANALYSIS_FAILED)
                )
                return F.struct(
                    asset.alias("asset"),
                    items.alias("evidence"),
                    F.coalesce(failure, bad).alias("failure"),
                )

            return let(own, checked)

        return let(F.struct(*[fields[n].alias(n) for n in ASSET.fieldNames()]), finish)

    return let(seen, build)


def evidence_rows(requests: DataFrame, observations: DataFrame, engines: Engines) -> DataFrame:
    """Requests with ``assets``, ``base_evidence``, ``part_failure`` and ``modalities`` in place of their artifacts."""
    rows = requests.join(group_observations(observations), "request_id", "left")
    rows = settle(rows, {"parts": F.transform("artifacts", lambda a, i: _asset(a, i + 1, engines))})
    rows = settle(
        rows,
        {
            "assets": F.transform("parts", lambda p: p["asset"]),
            "base_evidence": ev.union_evidence(
                F.col("post_text"), F.transform("parts", lambda p: p["evidence"]), F.lit(None)
            ),
            "part_failure": F.get(
                F.filter(F.transform("parts", lambda p: p["failure"]), lambda f: f.isNotNull()), F.lit(0)
            ),
        },
    ).drop("parts", "artifacts", "observations")
    return settle(rows, {"modalities": ev.modalities(F.col("assets"))})


def _early_failure() -> Column:
    """What fails a request before a model is asked."""
    return F.coalesce(
        F.when(~fits(F.col("post_text"), 10_000), _failure("analysis_failed", fixed.MSG_ANALYSIS_FAILED)),
        F.col("part_failure"),
        F.when(F.size("modalities") == 0, _failure("unsupported_media", fixed.MSG_UNSUPPORTED)),
    )


def precheck(rows: DataFrame) -> DataFrame:
    """Adds ``failure`` to evidence rows."""
    return settle(rows, {"failure": _early_failure()})


def analyze_content(
    requests: DataFrame,
    observations: DataFrame,
    replies: DataFrame | None = None,
    engines: Engines = Engines(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """request_id, ``output`` (the 20 output fields, null on failure), error_code
    and message; ``keep`` names request columns to carry along.

    ``requests`` are valid (see ``contracts``); ``observations`` has one row per
    (request_id, artifact_index); ``replies`` has request_id, reply, error for
    the requests a model answered. Everything per request happens inside its
    row, so the only exchanges are those that bring the three inputs together
    by request_id.
    """
    # 1. artifacts -> assets, evidence, failures
    rows = evidence_rows(requests, observations, engines)
    if replies is not None:
        rows = rows.join(replies.select("request_id", "reply", "error"), "request_id", "left")
    else:
        nothing = F.lit(None).cast("string")
        rows = rows.withColumns({"reply": nothing, "error": nothing})

    # 2. model answer or deterministic understanding
    vision_on = F.lit(engines.vision != fixed.VISION_DISABLED)
    asked = F.col("run_vision_model") & vision_on
    rows = settle(rows, {"answer": F.when(asked & F.col("error").isNull(), parse_semantic_payload("reply"))})
    # Texts reach the understanding in asset order.
    ocr_text = ev.joined(F.flatten(F.transform("assets", lambda a: a["ocr_text"])))
    spoken = F.transform("assets", lambda a: F.transform(a["transcript"], lambda s: s["text"]))
    # Only what no answer covers is read; the keywords stand in a step of their own, since no lambda can hold them.
    texts = collapsed_texts(F.col("post_text"), ev.joined(F.flatten(spoken)), ocr_text)
    rows = settle(rows, {"texts": F.when(F.col("answer").isNull(), texts)})
    rows = rows.withColumn("words", keywords("texts.text"))
    fallback = understanding(
        F.col("texts"), F.col("words"), F.col("modalities"), F.col("language_hint"), ev.first_refs(F.col("base_evidence"))
    )
    has_images = F.exists("assets", lambda a: (a["modality"] == "image") | (a["sampled_frame_count"] > 0))
    failed_warning = F.format_string(
        fixed.WARN_MODEL_FAILED.replace("{}", "%s"), F.coalesce("error", F.lit("ValidationError"))
    )
    unanswered = F.col("error").isNotNull() | (F.col("reply").isNotNull() & F.col("answer").isNull())
    rows = settle(
        rows,
        {
            "semantic": F.when(F.col("answer").isNotNull(), F.col("answer")).otherwise(fallback),
            "model_warnings": F.when(
                F.col("run_vision_model") & ~vision_on, F.array(F.lit(fixed.WARN_NO_MODEL))
            ).when(asked & unanswered, F.array(failed_warning)).otherwise(empty_array("string")),
            "visual": F.when(
                F.col("answer").isNotNull() & has_images, ev.visual_evidence(F.col("answer.confidence"))
            ).otherwise(empty_array(ev.EVIDENCE_DDL)),
        },
    ).drop("texts", "words")

    # 3. references, tags, warnings
    rows = settle(rows, {"evidence": F.concat("base_evidence", "visual")})
    visual_ref = F.transform("visual", lambda e: e["evidence_id"])
    refs = F.concat(
        evidence_refs(F.col("semantic.evidence_refs"), F.transform("evidence", lambda e: e["evidence_id"])),
        visual_ref,
    )
    skipped = F.transform(
        F.filter("assets", lambda a: a["modality"] == "unknown"), lambda a: a["warnings"]
    )
    asset_warnings = ev.merge_warnings(F.flatten(skipped), F.transform("assets", lambda a: a["warnings"]))
    rows = settle(
        rows,
        {
            "all_tags": union_tags(F.col("semantic"), F.col("modalities"), refs),
            "warnings": unique_texts(F.concat(asset_warnings, "model_warnings")),
        },
    )

    # 4. outcome
    failed = _failure("analysis_failed", fixed.MSG_ANALYSIS_FAILED)
    failure = F.coalesce(_early_failure(), F.when(~contracts.tags_ok(F.col("all_tags")), failed))
    confidence = clamp01(F.col("semantic.confidence"))
    outputs = {
        **{n: F.col(f"semantic.{n}") for n in (
            "language", "claims", "image_summary", "video_summary", "transcript_summary",
            "sentiment", "commercial_intent", "safety_flags",
        )},
        **apply_output_switches(
            F.col("semantic.summary"), dedupe_tags(F.col("all_tags")),
            F.col("semantic.topics"), F.col("semantic.entities"),
        ),
        "confidence": confidence,
        "evidence": F.col("evidence"),
        "needs_human_review": review_flag(confidence),
        "assets": F.col("assets"),
        "warnings": F.col("warnings"),
        "cache_hit": F.lit(False),
        "pipeline_version": F.lit(engines.version),
        "model_versions": F.create_map(
            F.lit("ocr"), F.lit(engines.ocr), F.lit("asr"), F.lit(engines.asr),
            F.lit("content_understander"), F.lit(engines.vision),
        ),
    }
    rows = settle(rows, {"failure": failure})
    output = F.struct(*[outputs[f.name].cast(f.dataType).alias(f.name) for f in ANALYSIS.fields])
    return settle(
        rows.withColumns({"error_code": F.col("failure.code"), "message": F.col("failure.message")}),
        {"output": F.when(F.col("failure").isNull(), output)},
    ).select("request_id", *keep, "output", "error_code", "message")


def apply_output_switches(summary: Column, tags: Column, topics: Column, entities: Column) -> dict[str, Column]:
    """``generate_summary`` blanks the summary; ``generate_tags`` empties tags,
    topics and entities; claims always stay."""
    show, tag = F.col("generate_summary"), F.col("generate_tags")
    return {
        "summary": F.when(show, summary).otherwise(""),
        "tags": F.when(tag, tags).otherwise(empty_array(TAG_DDL)),
        "topics": F.when(tag, topics).otherwise(empty_array("string")),
        "entities": F.when(tag, entities).otherwise(empty_array("string")),
    }

