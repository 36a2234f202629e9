"""Tags of a request, built and de-duplicated inside its row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.core import empty_array, let, strip
from ..functions.text import fold_case
from ..schemas import TAG

TAG_DDL = TAG.simpleString()


def _tag(namespace: str, label: Column, confidence: Column, refs: Column) -> Column:
    return F.struct(
        F.lit(namespace).alias("namespace"),
        label.alias("label"),
        confidence.alias("confidence"),
        refs.alias("evidence_refs"),
    )


def union_tags(semantic: Column, modalities: Column, refs: Column) -> Column:
    """Topic, entity, format, sentiment, commercial and safety tags, in that order."""
    confidence = semantic["confidence"]

    def many(namespace: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: _tag(namespace, x, confidence, refs))

    formats = F.transform(
        F.sort_array(modalities), lambda m: _tag("format", m, F.lit(1.0), empty_array("string"))
    )
    intent = semantic["commercial_intent"]
    commercial = F.when(
        F.length(intent) > 0, F.array(_tag("commercial", intent, confidence, refs))
    ).otherwise(empty_array(TAG_DDL))
    return F.concat(
        many("topic", semantic["topics"]),
        many("entity", semantic["entities"]),
        formats,
        F.array(_tag("sentiment", semantic["sentiment"], confidence, refs)),
        commercial,
        many("safety", semantic["safety_flags"]),
    )


def dedupe_tags(tags: Column) -> Column:
    """First tag per namespace and case-folded label; blank labels dropped."""

    def key(tag: Column) -> Column:
        return F.concat_ws("\x00", tag["namespace"], fold_case(tag["label"]))

    def keep_first(keys: Column) -> Column:
        return F.filter(
            tags,
            lambda t, i: (F.length(strip(t["label"])) > 0)
            & (F.array_position(keys, F.get(keys, i)) == i + 1),
        )

    return let(F.transform(tags, key), keep_first)
