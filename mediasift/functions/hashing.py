"""Cache keys, content hashes, sink partition names, version strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import fixed
from .core import col
from .urls import normalized_url

_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_LONG_ESCAPES = tuple(chr(c) for c in range(32) if chr(c) not in "\n\r\t\b\f")


@dataclass(frozen=True)
class Engines:
    """Names of the plugged-in engines; the defaults mean "none"."""

    ocr: str = fixed.OCR_DISABLED
    asr: str = fixed.ASR_DISABLED
    vision: str = fixed.VISION_DISABLED
    base: str = fixed.BASE_PIPELINE_VERSION

    @property
    def version(self) -> str:
        return f"{self.base}|ocr={self.ocr}|asr={self.asr}|vision={self.vision}"


def model_versions(ocr: Column, asr: Column, vision: Column) -> Column:
    return F.create_map(
        F.lit("ocr"), ocr, F.lit("asr"), asr, F.lit("content_understander"), vision
    )


def engine_version(ocr: Column, asr: Column, vision: Column, base: str = fixed.BASE_PIPELINE_VERSION) -> Column:
    return F.concat_ws(
        "|",
        F.lit(base),
        F.concat(F.lit("ocr="), ocr),
        F.concat(F.lit("asr="), asr),
        F.concat(F.lit("vision="), vision),
    )


def json_string(text: Column) -> Column:
    """JSON string literal: short escapes, lower-case \\u00xx for other control
    characters, everything else as is; ``null`` for null."""
    escaped = text
    for raw, shown in _SHORT_ESCAPES:
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    rare = escaped
    for raw in _LONG_ESCAPES:
        rare = F.replace(rare, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    body = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(escaped)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _json_scalar(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def cache_key(request: dict[str, Column], version: Column | str) -> Column:
    """SHA-256 of the canonical JSON of the fields that decide a result: sorted
    keys, no spaces. Path, size, size cap and the force flag are left out."""
    version = F.lit(version) if isinstance(version, str) else version
    artifacts = F.array_join(
        F.transform(
            request["artifacts"],
            lambda a: F.concat(
                F.lit('{"media_type":'), json_string(a["media_type"]),
                F.lit(',"sha256":'), json_string(F.lower(a["sha256"])), F.lit("}"),
            ),
        ),
        ",",
    )
    parts = {
        "artifacts": F.concat(F.lit("["), artifacts, F.lit("]")),
        "generate_summary": _json_scalar(request["generate_summary"]),
        "generate_tags": _json_scalar(request["generate_tags"]),
        "language_hint": json_string(request["language_hint"]),
        "max_keyframes": _json_scalar(request["max_keyframes"]),
        "max_video_duration_seconds": _json_scalar(request["max_video_duration_seconds"]),
        "pipeline_version": json_string(version),
        "post_text": json_string(request["post_text"]),
        "run_ocr": _json_scalar(request["run_ocr"]),
        "run_vision_model": _json_scalar(request["run_vision_model"]),
        "source_url": json_string(normalized_url(request["source_url"])),
        "transcribe_audio": _json_scalar(request["transcribe_audio"]),
    }
    pieces: list[Column] = []
    for i, (name, value) in enumerate(sorted(parts.items())):
        pieces += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), value]
    return F.sha2(F.concat(*pieces, F.lit("}")), 256)


def content_hash(value: Column, *, keep_nulls: bool = True) -> Column:
    """SHA-256 of the JSON of a struct; a null struct hashes the text ``null``."""
    text = F.to_json(value, {"ignoreNullFields": "false" if keep_nulls else "true"})
    # Other control characters come with upper-case hex digits; the hashed form has lower case.
    lower = text
    for raw in _LONG_ESCAPES:
        if f"{ord(raw):X}" != f"{ord(raw):x}":
            lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{ord(raw):04X}", rf"$1\\u{ord(raw):04x}")
    text = F.when(text.contains("\\u00"), lower).otherwise(text)
    return F.sha2(F.coalesce(F.when(value.isNotNull(), text), F.lit("null")), 256)


def tenant_partition(tenant: Column | str) -> Column:
    safe = F.left(F.regexp_replace(col(tenant), "[^A-Za-z0-9_.-]", "_"), F.lit(64))
    return F.when(safe == "", "tenant").otherwise(safe)
