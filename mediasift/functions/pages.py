"""Functions over saved page HTML."""

from __future__ import annotations

import html as _html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import fixed
from .core import col, nonempty
from .urls import valid_media_host


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


def html_unescape(text: Column | str) -> Column:
    """All named and numeric entities. The entity table is the standard
    library's, so this is an Arrow UDF; texts without ``&`` are not sent to it."""
    text = col(text)
    return F.when(text.contains("&"), _unescape(F.when(text.contains("&"), text))).otherwise(text)


def markup_unescape(text: Column | str) -> Column:
    """Only what escaping for markup writes: the five references to its own characters, each closed by a semicolon.
    An ampersand that begins none of these stays, as ``&amp`` without semicolon does."""
    text = col(text)
    for reference, character in fixed.MARKUP_REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def video_id_from_html(html: Column | str) -> Column:
    return nonempty(F.regexp_extract(col(html), f"{fixed.VIDEO_ID_MARK}([0-9]+)%22", 1))


def percent_decode(text: Column) -> Column:
    """Decode %XX; a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def encoded_play_address(html: Column | str, video_id: Column) -> Column:
    """Decoded play address that follows the marker of this id, null when absent."""
    html = col(html)
    start = F.instr(html, F.concat(F.lit(fixed.VIDEO_ID_MARK), video_id, F.lit("%22")))
    window = F.substr(html, start, F.lit(fixed.PLAY_WINDOW_CHARS))
    found = F.regexp_extract(window, f"{fixed.PLAY_ADDRESS_MARK}(.*?)%22", 1)
    return F.when(start > 0, percent_decode(nonempty(found)))


def play_url_from_html(html: Column | str, video_id: Column) -> Column:
    """Play address on an accepted media host, else null."""
    address = encoded_play_address(html, video_id)
    return F.when(valid_media_host(address), address)


def page_title(
    html: Column | str,
    page_id: Column,
    *,
    site: str = "Douyin",
    pattern: str = fixed.META_TITLE_PATTERN,
    unescape: Callable[[Column], Column] = html_unescape,
) -> Column:
    """Unescaped title; the default name when missing or undecodable."""
    html = col(html)
    default = F.concat(F.lit(f"{site}-"), page_id.cast("string"))
    title = unescape(F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)))
    return F.when(title.isNull() | title.contains("\ufffd"), default).otherwise(title)
