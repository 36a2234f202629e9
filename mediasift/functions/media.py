"""Media-type detection, probe logs, timestamps, display formats, average hash."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, functions as F

from .. import fixed
from .casts import nonneg_float, positive_int
from .core import col, let, nonempty, sql_text

_PROBE = (
    "struct<format:struct<duration:string>,"
    "streams:array<struct<codec_type:string,width:string,height:string>>>"
)


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), "([^/]*)/*$", 1)


def suffix(path: Column | str) -> Column:
    """Lower-case last suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def guess_media_type(path: Column | str) -> Column:
    """Media type by file name, from the standard library's table."""
    table = mimetypes.MimeTypes(filenames=()).types_map[True]
    pairs = ", ".join(sql_text(part) for item in sorted(table.items()) for part in item)
    return F.try_element_at(F.expr(f"map({pairs})"), suffix(path))


def detect_media(path: Column | str, declared: Column | str) -> Column:
    """struct<media_type, modality>: declared type, else guess, else octet-stream;
    image before video before audio, each by type prefix or by suffix."""
    ext = suffix(path)
    known = F.lower(
        F.coalesce(nonempty(col(declared)), guess_media_type(path), F.lit("application/octet-stream"))
    )

    def decide(kind: Column) -> Column:
        def result(media_type: Column, modality: str) -> Column:
            return F.struct(media_type.alias("media_type"), F.lit(modality).alias("modality"))

        chain = None
        for modality, suffixes in (
            ("image", fixed.IMAGE_SUFFIXES),
            ("video", fixed.VIDEO_SUFFIXES),
            ("audio", fixed.AUDIO_SUFFIXES),
        ):
            by_type = kind.startswith(f"{modality}/")
            shown = F.when(by_type, kind).otherwise(f"{modality}/unknown")
            test = by_type | ext.isin(*suffixes)
            chain = (
                F.when(test, result(shown, modality))
                if chain is None
                else chain.when(test, result(shown, modality))
            )
        return chain.otherwise(result(kind, "unknown"))

    return let(known, decide)


def prompt_image_type(path: Column | str) -> Column:
    ext = suffix(path)
    chain = None
    for key, value in fixed.PROMPT_IMAGE_TYPES.items():
        chain = F.when(ext == key, value) if chain is None else chain.when(ext == key, value)
    return chain.otherwise("image/jpeg")


def parse_probe_output(log: Column | str) -> Column:
    """struct<duration,width,height,valid> from a JSON probe result or from a
    textual one with ``Duration: H:M:S`` and ``Video: ... WxH``."""
    log = col(log)
    parsed = F.from_json(log, _PROBE)
    is_json = log.rlike(r"^\s*\{")
    video = F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    clock = r"Duration:\s*(\d+):(\d+):([\d.]+)"
    size = r"Video:.*?\s(\d{2,5})x(\d{2,5})"

    def part(pattern: str, group: int) -> Column:
        return nonempty(F.regexp_extract(log, pattern, group))

    seconds = (
        part(clock, 1).try_cast("bigint") * 3600
        + part(clock, 2).try_cast("bigint") * 60
        + part(clock, 3).try_cast("double")
    )
    return F.struct(
        F.when(is_json, nonneg_float(parsed["format"]["duration"])).otherwise(seconds).alias("duration"),
        F.when(is_json, positive_int(video["width"])).otherwise(positive_int(part(size, 1))).alias("width"),
        F.when(is_json, positive_int(video["height"])).otherwise(positive_int(part(size, 2))).alias("height"),
        F.when(is_json, F.coalesce(F.size(parsed["streams"]) > 0, F.lit(False)))
        .otherwise(log.rlike("Stream #|Duration:"))
        .alias("valid"),
    )


def uniform_timestamps(duration: Column | str, maximum: Column | int) -> Column:
    """Midpoints of n equal parts, one per ten seconds up to ``maximum``; [0.0] without a duration."""
    duration = col(duration)
    cap = maximum if isinstance(maximum, Column) else F.lit(maximum)
    n = F.least(cap, F.greatest(F.lit(1), F.ceil(duration / 10.0))).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + F.lit(0.5)) / n)
    return F.when(duration > 0, points).otherwise(F.array(F.lit(0.0)))


def sample_indices(n: Column, maximum: int) -> Column:
    """0-based indices of an even sample; half-even rounding, all when n <= maximum."""
    if maximum == 1:
        picked = F.array(F.floor(n / 2).cast("bigint"))
    else:
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(maximum - 1)),
            lambda i: F.bround(i * (n - 1) / F.lit(maximum - 1)).cast("bigint"),
        )
    everything = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    return F.when(n <= maximum, everything).otherwise(picked)


def evenly_sample(values: Column, maximum: int) -> Column:
    """Even sample of an array, order kept."""
    return F.when(F.size(values) <= maximum, values).otherwise(
        F.transform(sample_indices(F.size(values), maximum), lambda i: F.get(values, i.cast("int")))
    )


def average_hash(cells: Column | str) -> Column:
    """``ahash:`` + 16 hex digits: one bit per cell, set where cell >= mean of the 64 cells."""
    cells = F.transform(col(cells), lambda x: x.cast("double"))

    def digits(values: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)

        def nibbles(average: Column) -> Column:
            bits = F.transform(values, lambda x: F.when(x >= average, "1").otherwise("0"))
            return F.concat(
                *[
                    F.lower(F.lpad(F.conv(F.array_join(F.slice(bits, start, 32), ""), 2, 16), 8, "0"))
                    for start in (1, 33)
                ]
            )

        return let(mean, nibbles)

    return F.concat(F.lit("ahash:"), let(cells, digits))


def format_bytes(size: Column | str) -> Column:
    size = F.coalesce(col(size).cast("double"), F.lit(0.0))
    kb = 1024.0
    scaled = [(unit, size / F.lit(kb**i)) for i, unit in enumerate(("B", "KB", "MB", "GB"))]
    shown = [F.format_string("%.0f B", F.bround(size))] + [
        F.format_string(f"%.1f {unit}", F.bround(value, 1)) for unit, value in scaled[1:]
    ]
    return (
        F.when(size < kb, shown[0])
        .when(size < kb**2, shown[1])
        .when(size < kb**3, shown[2])
        .otherwise(shown[3])
    )


def format_duration(seconds: Column | str) -> Column:
    total = F.bround(col(seconds).cast("double")).cast("bigint")
    return F.format_string("%d:%02d", F.floor(total / 60).cast("bigint"), F.pmod(total, F.lit(60)))


def progress_percent(
    status: Column, downloaded: Column, total: Column, estimate: Column
) -> Column:
    """Percent shown for a progress event; null for states that show nothing."""
    size = F.coalesce(F.when(total != 0, total), F.when(estimate != 0, estimate))
    known = (downloaded != 0) & size.isNotNull()
    share = F.when(known, (downloaded / size * 92).cast("bigint")).otherwise(F.lit(18).cast("bigint"))
    clamped = F.greatest(F.lit(2), F.least(share, F.lit(92)))
    return (
        F.when(status == "finished", F.lit(96).cast("bigint"))
        .when(status == "succeeded", F.lit(100).cast("bigint"))
        .when(status == "downloading", clamped.cast("bigint"))
    )

