"""URL functions. Parts are taken by regular expression, so that addresses a
strict URI parser would refuse still split the lenient way."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import fixed
from .core import any_of, col, nonempty, strip, text_array

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), _SCHEME, 1))


def url_authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _AUTHORITY, 1)


def has_credentials(url: Column | str) -> Column:
    user = F.regexp_extract(url_authority(url), "^(.*)@", 1)
    return ~user.isin("", ":")


def url_host(url: Column | str) -> Column:
    """Lower-case host without trailing dots; null when there is none."""
    host_port = F.regexp_replace(url_authority(url), "^.*@", "")
    host = F.when(
        host_port.startswith("["), F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_extract(host_port, "^([^:]*)", 1))
    return nonempty(F.rtrim(F.lower(host), F.lit(".")))


def throttle_host(url: Column | str) -> Column:
    return F.coalesce(url_host(url), F.lit("unknown"))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def normalized_url(url: Column | str) -> Column:
    """Lower-case scheme and host, no default port, ``/`` for an empty path."""
    url = col(url)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    port = F.regexp_extract(url_authority(url), r":(\d+)$", 1)
    default = F.when(url_scheme(url) == "https", "443").when(url_scheme(url) == "http", "80").otherwise("")
    user = F.regexp_extract(url_authority(url), "^(.*@)", 1)
    return F.when(
        url_authority(url) != "",
        F.concat(
            url_scheme(url), F.lit("://"), user,
            F.lower(F.regexp_replace(F.regexp_replace(url_authority(url), "^.*@", ""), r":\d*$", "")),
            F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)),
            F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
        ),
    ).otherwise(url)


def is_domain(host: Column, *domains: str) -> Column:
    """Equal to one of the domains or below it."""
    return F.coalesce(
        any_of((host == d) | host.endswith(f".{d}") for d in domains), F.lit(False)
    )


def loose_suffix(host: Column, *domains: str) -> Column:
    """The looser test used for image posts: no dot is required before the suffix."""
    return F.coalesce(any_of(host.endswith(d) for d in domains), F.lit(False))


def supports_image_posts(url: Column | str) -> Column:
    return loose_suffix(url_host(url), *fixed.IMAGE_POST_DOMAINS)


def matched_domain(host: Column, domains: Iterable[str]) -> Column:
    """The longest of the given domains that the host equals or lies below.

    For a short fixed list: every label's suffix is compared with all of it inside the row. A list of
    any length is a table (``policy.below_allowed``).
    """
    known = text_array(sorted(set(domains)))
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(
        host.isNotNull(), F.get(F.filter(suffixes, lambda s: F.array_contains(known, s)), F.lit(0))
    )


def query_value(url: Column | str, name: str) -> Column:
    """First non-blank value of a query parameter, decoded, '' when absent."""
    value = F.regexp_extract(url_query(url), f"(?:^|&){name}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(value), value)


def modal_id(url: Column | str) -> Column:
    value = query_value(url, "modal_id")
    return F.when(value.rlike("^[0-9]+$"), value)


def normalize_video_url(url: Column | str) -> Column:
    url = col(url)
    return F.when(
        is_domain(url_host(url), fixed.VIDEO_SITE) & modal_id(url).isNotNull(),
        F.concat(F.lit(f"https://www.{fixed.VIDEO_SITE}/video/"), modal_id(url)),
    ).otherwise(url)


def video_id_from_url(url: Column | str) -> Column:
    return F.coalesce(modal_id(url), nonempty(F.regexp_extract(url_path(url), "/video/([0-9]+)", 1)))


def extract_post_url(shared: Column | str) -> Column:
    """First http(s) address in share text, https for the sites known to support it."""
    trimmed = strip(shared)
    found = F.regexp_extract(trimmed, f"(?i)https?://[^{fixed.WS}，。；;！!]+", 0)
    candidate = F.regexp_replace(F.when(found == "", trimmed).otherwise(found), "[)\\]}>'\"]+$", "")
    upgrade = (url_scheme(candidate) == "http") & is_domain(
        url_host(candidate), *fixed.HTTPS_UPGRADE_DOMAINS
    )
    return F.when(upgrade, F.regexp_replace(candidate, "^[A-Za-z]+:", "https:")).otherwise(candidate)


def valid_media_host(url: Column | str) -> Column:
    """https and strictly below one of the media domains."""
    host = url_host(url)
    # A dot behind the host is not stripped here: what is allowed must match as written.
    dotted = F.regexp_replace(url_authority(url), "^.*@|:[0-9]*$", "").endswith(".")
    below = any_of(host.endswith(f".{d}") for d in fixed.MEDIA_HOST_DOMAINS)
    return F.coalesce(col(url).startswith("https://") & below & ~dotted, F.lit(False))


def http_url(value: Column) -> Column:
    """The value if it is an http(s) address with a usable host and port and of no more than
    2,083 characters, else null."""
    ok = value.rlike(r"^https?://(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^/?#@:\s\[\]]+)(?::[0-9]{1,5})?(?:[/?#].*)?$")
    port = F.regexp_extract(value, r"^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#@:]*):([0-9]{1,5})", 1)
    return F.when(ok & (F.length(value) <= 2083) & ((port == "") | (port.cast("int") <= 65535)), value)
