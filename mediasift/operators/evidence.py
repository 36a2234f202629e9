"""Evidence: numbered, ordered, in arrays. One artifact's lines and segments
live in one row, so de-duplication and numbering are row-local."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from ..functions.core import empty_array, unique_texts
from ..schemas import EVIDENCE

EVIDENCE_DDL = EVIDENCE.simpleString()


def _item(
    evidence_id: Column, kind: str, sha256: Column, text: Column, second: Column, confidence: Column
) -> Column:
    return F.struct(
        evidence_id.alias("evidence_id"),
        F.lit(kind).alias("kind"),
        sha256.cast("string").alias("artifact_sha256"),
        text.alias("text"),
        second.cast("double").alias("timestamp_seconds"),
        confidence.cast("double").alias("confidence"),
    )


def _numbered(prefix: str, artifact_index: Column, i: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), artifact_index.cast("string"), (i + 1).cast("string"))


def post_evidence(post_text: Column) -> Column:
    nothing = F.lit(None)
    one = F.array(_item(F.lit(fixed.POST_EVIDENCE), "post_text", nothing, post_text, nothing, F.lit(1.0)))
    return F.when(post_text != "", one).otherwise(empty_array(EVIDENCE_DDL))


def ocr_evidence(artifact_index: Column, sha256: Column, lines: Column, modality: Column) -> Column:
    """``ocr-{artifact}-{n}`` over lines already unique; 0.85 for images, 0.8 for video frames."""
    confidence = F.when(modality == "video", 0.8).otherwise(0.85)
    return F.transform(
        lines,
        lambda t, i: _item(
            _numbered("ocr", artifact_index, i), "ocr", sha256, t, F.lit(None), confidence
        ),
    )


def transcript_evidence(artifact_index: Column, sha256: Column, segments: Column) -> Column:
    return F.transform(
        segments,
        lambda s, i: _item(
            _numbered("transcript", artifact_index, i),
            "transcript", sha256, s["text"], s["start_seconds"], F.lit(0.85),
        ),
    )


def visual_evidence(confidence: Column) -> Column:
    nothing = F.lit(None)
    return F.array(
        _item(F.lit("visual-model-1"), "visual", nothing, F.lit(fixed.VISUAL_EVIDENCE), nothing, confidence)
    )


def union_evidence(post_text: Column, per_asset: Column, visual: Column) -> Column:
    """Post text, then each asset's evidence in asset order, then the visual row."""
    return F.concat(
        post_evidence(post_text),
        F.flatten(per_asset),
        F.coalesce(visual, empty_array(EVIDENCE_DDL)),
    )


def clean_segments(segments: Column) -> Column:
    """Recognizer segments with start >= 0, end >= start, trimmed non-empty text."""
    from ..functions.core import strip

    shaped = F.transform(
        segments,
        lambda s: F.struct(
            F.greatest(F.lit(0.0), s["start_seconds"]).alias("start_seconds"),
            F.greatest(s["start_seconds"], s["end_seconds"]).alias("end_seconds"),
            strip(s["text"]).alias("text"),
        ),
    )
    return F.filter(shaped, lambda s: s["text"] != "")


def joined(texts: Column) -> Column:
    return F.array_join(texts, " ")


def ordered_text(post_text: Column, transcript_text: Column, ocr_text: Column) -> Column:
    """Post, transcript and OCR text joined by a space, empty parts left out."""
    return F.concat_ws(" ", *[F.when(part != "", part) for part in (post_text, transcript_text, ocr_text)])


def trusted_context(assets: Column) -> Column:
    """One line per asset; zero and unknown numbers show as a question mark."""

    def shown(value: Column) -> Column:
        return F.coalesce(F.when(value != 0, value.cast("string")), F.lit("?"))

    return F.array_join(
        F.transform(
            assets,
            lambda a, i: F.concat(
                F.lit("asset-"), (i + 1).cast("string"),
                F.lit(": modality="), a["modality"],
                F.lit(", media_type="), a["media_type"],
                F.lit(", size="), shown(a["width"]), F.lit("x"), shown(a["height"]),
                F.lit(", duration="), shown(a["duration_seconds"]),
                F.lit("s, sampled_frames="), a["sampled_frame_count"].cast("string"),
            ),
        ),
        "\n",
    )


def untrusted_context(evidence: Column) -> Column:
    with_text = F.filter(evidence, lambda e: e["text"] != "")
    lines = F.transform(
        with_text,
        lambda e: F.concat(F.lit("["), e["evidence_id"], F.lit("|"), e["kind"], F.lit("] "), e["text"]),
    )
    return F.left(F.array_join(lines, "\n"), F.lit(fixed.CONTEXT_CHARS))


def first_refs(evidence: Column) -> Column:
    """First 20 evidence ids that have text."""
    with_text = F.filter(evidence, lambda e: e["text"] != "")
    return F.transform(F.slice(with_text, 1, fixed.REFS), lambda e: e["evidence_id"])


def modalities(assets: Column) -> Column:
    """Distinct known modalities in asset order."""
    return F.array_distinct(
        F.filter(F.transform(assets, lambda a: a["modality"]), lambda m: m != "unknown")
    )


def merge_warnings(request: Column, assets: Column) -> Column:
    """Request warnings, then asset warnings in asset order, distinct."""
    return unique_texts(F.concat(request, F.flatten(assets)))
