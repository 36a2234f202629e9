"""Model replies: fence removal, typed parsing with defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from ..schemas import SEMANTIC
from .casts import field, variant_type
from .core import col, empty_array, let, strip

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip_json_fence(reply: Column | str) -> Column:
    """Trim; drop an opening code-fence line and a closing fence line."""
    value = strip(reply)
    lines = F.regexp_replace(value, _LINE_END, "\n")
    body = F.regexp_replace(lines, r"^[^\n]*(?:\n|$)", "")
    inner = F.regexp_replace(body, r"(?:^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(value.startswith("```"), strip(inner)).otherwise(value)


def reply_text(content: Column | str) -> Column:
    """Text of a reply whose JSON content is a string or a list of parts."""
    value = F.try_parse_json(col(content))
    parts = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(
        parts,
        lambda p: F.when(
            variant_type(p).startswith("OBJECT"),
            F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
        ).otherwise(F.try_variant_get(p, "$", "string")),
    )
    return F.coalesce(F.array_join(texts, ""), F.try_variant_get(value, "$", "string"))


def parse_semantic_payload(reply: Column | str) -> Column:
    """The 13 semantic fields with their defaults, or null when the reply is no
    JSON object, a field has a wrong type, or confidence leaves [0, 1]."""
    required = {"language": "unknown", "summary": "", "sentiment": "neutral"}
    optional = ("image_summary", "video_summary", "transcript_summary", "commercial_intent")
    lists = ("topics", "entities", "claims", "safety_flags", "evidence_refs")

    def build(record: Column) -> Column:
        ok = variant_type(record).startswith("OBJECT")
        out: dict[str, Column] = {}
        for name, default in required.items():
            kind = variant_type(field(record, name))
            ok = ok & (kind.isNull() | (kind == "STRING"))
            out[name] = F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(default))
        for name in optional:
            kind = variant_type(field(record, name))
            ok = ok & (kind.isNull() | kind.isin("STRING", "VOID"))
            out[name] = F.try_variant_get(record, f"$.{name}", "string")
        for name in lists:
            kind = variant_type(field(record, name))
            ok = ok & (kind.isNull() | kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY"))
            items = F.try_variant_get(record, f"$.{name}", "array<string>")
            ok = ok & ~F.coalesce(F.exists(items, lambda x: x.isNull()), F.lit(False))
            out[name] = F.coalesce(items, empty_array("string"))
        kind = variant_type(field(record, "confidence"))
        score = F.coalesce(
            F.try_variant_get(record, "$.confidence", "double"),
            F.when(kind.isNull(), F.lit(0.5)),
        )
        out["confidence"] = score
        ok = ok & score.isNotNull() & (score >= 0) & (score <= 1)
        return F.when(ok, F.struct(*[out[n].alias(n) for n in SEMANTIC.fieldNames()]))

    return let(F.try_parse_json(strip_json_fence(reply)), build)


def evidence_refs(refs: Column, known: Column) -> Column:
    """References to evidence that exists, order and repeats kept."""
    return F.filter(refs, lambda r: F.array_contains(known, r))


def review_flag(confidence: Column) -> Column:
    return confidence < fixed.REVIEW_BELOW


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
