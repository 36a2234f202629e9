"""Deterministic understanding of posts: language, summary, topics, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import empty_array, let, nonempty
from ..functions.text import (
    collapse_ws,
    compact_collapsed,
    detect_language,
    first_sentence_collapsed,
    keywords,
)
from ..schemas import SEMANTIC


def semantic_fields(
    text: Column, post: Column, spoken: Column, seen: Column, topics: Column, modalities: Column, hint: Column, refs: Column
) -> dict[str, Column]:
    """The 13 semantic fields of collapsed texts; ``text`` is post, transcript and OCR text together,
    ``topics`` its keywords."""
    av = F.concat_ws(" ", nonempty(spoken), nonempty(seen))
    claim = first_sentence_collapsed(post)
    has_text = text != ""
    head, tail = fixed.NO_TEXT_SUMMARY
    no_text = F.concat(F.lit(head), F.array_join(modalities, " and "), F.lit(tail))
    fields = {
        "language": F.coalesce(nonempty(hint), detect_language(text)),
        "summary": F.when(has_text, compact_collapsed(text)).otherwise(no_text),
        "topics": topics,
        "entities": empty_array("string"),
        "claims": F.when(claim != "", F.array(claim)).otherwise(empty_array("string")),
        "image_summary": F.when(
            F.array_contains(modalities, "image"), F.coalesce(nonempty(compact_collapsed(seen)), F.lit(fixed.IMAGE_SUMMARY))
        ),
        "video_summary": F.when(
            F.array_contains(modalities, "video"), F.coalesce(nonempty(compact_collapsed(av)), F.lit(fixed.VIDEO_SUMMARY))
        ),
        "transcript_summary": nonempty(compact_collapsed(spoken)),
        "sentiment": F.lit("neutral"),
        "commercial_intent": F.lit(None).cast("string"),
        "safety_flags": empty_array("string"),
        "confidence": F.when(has_text, 0.5).otherwise(0.3),
        "evidence_refs": refs,
    }
    return {n: fields[n] for n in SEMANTIC.fieldNames()}


def collapsed_texts(post_text: Column, transcript_text: Column, ocr_text: Column) -> Column:
    """struct<post, spoken, seen, text>, each collapsed once, ``text`` all together; null texts count as empty.

    Summaries, keywords, language and claims all read the collapsed form, in which no token or letter differs.
    """

    def clean(text: Column) -> Column:
        return collapse_ws(F.coalesce(text, F.lit("")))

    def together(t: Column) -> Column:
        text = F.concat_ws(" ", nonempty(t["post"]), nonempty(t["spoken"]), nonempty(t["seen"]))
        return F.struct(t["post"].alias("post"), t["spoken"].alias("spoken"), t["seen"].alias("seen"), text.alias("text"))

    parts = F.struct(clean(post_text).alias("post"), clean(transcript_text).alias("spoken"), clean(ocr_text).alias("seen"))
    return let(parts, together)


def understanding(texts: Column, topics: Column, modalities: Column, hint: Column, refs: Column) -> Column:
    """The semantic fields derived from ``collapsed_texts`` and their keywords alone, as one struct."""
    fields = semantic_fields(
        texts["text"], texts["post"], texts["spoken"], texts["seen"], topics, modalities, hint, refs
    )
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def understand_posts(posts: DataFrame) -> DataFrame:
    """One row per post: request_id and the 13 semantic fields, by the rule of ``understanding`` for a post alone.

    Needs request_id, post_text and optionally language_hint. Row-local: one
    scan, no exchange.
    """
    hint = F.col("language_hint") if "language_hint" in posts.columns else F.lit(None).cast("string")
    norm = posts.select(
        "request_id", hint.alias("hint"), collapse_ws(F.coalesce("post_text", F.lit(""))).alias("norm")
    )
    text, nothing = F.col("norm"), F.lit("")
    refs = F.when(text != "", F.array(F.lit(fixed.POST_EVIDENCE))).otherwise(empty_array("string"))
    fields = semantic_fields(text, text, nothing, nothing, keywords(text), empty_array("string"), F.col("hint"), refs)
    return norm.select("request_id", *[value.alias(name) for name, value in fields.items()])
