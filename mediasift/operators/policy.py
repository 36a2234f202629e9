"""URL policy: scheme and credentials, domain allowlist, platform, resolved addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.core import int_array, let
from ..functions.urls import has_credentials, matched_domain, url_host, url_scheme
from ..sources.catalog import platform_catalog


def domain_table(spark: SparkSession, allowed: DataFrame | Iterable[str]) -> DataFrame:
    """The allowlist as a table (domain). An empty list is an error."""
    if not isinstance(allowed, DataFrame):
        allowed = spark.createDataFrame([(d,) for d in allowed], "domain string")
    if allowed.isEmpty():
        raise ValueError("the list of allowed domains is empty")
    return allowed.select("domain")


def below_allowed(hosts: DataFrame, allowed: DataFrame) -> DataFrame:
    """The distinct hosts (host) that equal an allowed domain or lie below one.

    A host is cut into its suffixes, one a label, which meet the list in an equi join: the cost does not
    grow with the list, and neither side needs to be small.
    """
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    suffixes = hosts.filter(F.col("host").isNotNull()).select("host").distinct().select("host", suffix.alias("domain"))
    return suffixes.join(allowed, "domain", "left_semi").select("host").distinct()


def url_policy(urls: DataFrame, allowed: DataFrame | Iterable[str], url: str = "url") -> DataFrame:
    """Adds ``host`` and ``error_code``: ``unsafe_url`` before ``permission_denied``; null when the address passes.

    ``allowed`` is a table of domains, or a few of them. An empty list is an error. A host that very many addresses
    share skews the side of the addresses only, which the adaptive join can split.
    """
    known = domain_table(urls.sparkSession, allowed)
    rows = urls.withColumn("host", url_host(F.col(url)))
    safe = (url_scheme(F.col(url)) == "https") & F.col("host").isNotNull() & ~has_credentials(F.col(url))
    passed = below_allowed(rows, known).withColumn("_passed", F.lit(True))
    return rows.join(passed, "host", "left").select(
        *urls.columns, "host",
        F.when(~F.coalesce(safe, F.lit(False)), "unsafe_url").when(F.col("_passed").isNull(), "permission_denied").alias("error_code"),
    )


def classify_platform(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds the platform of each address.

    The host is cut down to the catalog domain it belongs to inside the row,
    which turns "equal or subdomain" into an equi join with the fixed
    21-domain catalog; the large side is not shuffled.
    """
    catalog = platform_catalog(urls.sparkSession)
    domains = [d for platform in fixed.PLATFORMS for d in platform[2]]
    return urls.withColumn("domain", matched_domain(url_host(url), domains)).join(
        F.broadcast(catalog), "domain", "left"
    )


# --- resolved addresses -----------------------------------------------------
def _v4_number(ip: Column) -> Column:
    def combine(octets: Column) -> Column:
        return F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, o: n * 256 + o.cast("bigint"))

    return combine(F.split(ip, r"\."))


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def v6_hex(ip: Column) -> Column:
    """32 lower-case hex digits of an IPv6 address, so that text order is address order."""
    tail = F.regexp_extract(ip, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    mapped = F.lower(F.lpad(F.hex(_v4_number(tail)), 8, "0"))
    plain = F.when(
        tail != "",
        F.concat(
            F.regexp_replace(ip, r"\d+\.\d+\.\d+\.\d+$", ""),
            F.left(mapped, F.lit(4)), F.lit(":"), F.right(mapped, F.lit(4)),
        ),
    ).otherwise(ip)
    halves = F.split(F.regexp_replace(F.lower(plain), "%.*$", ""), "::")
    head, rest = _groups(F.get(halves, F.lit(0))), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(head) - F.size(rest)))
    return F.array_join(F.transform(F.concat(head, zeros, rest), lambda g: F.lpad(g, 4, "0")), "")


def _inside(value: Column, networks: Iterable[str]) -> Column:
    """Whether an address (number, or hex text for IPv6) lies in one of the networks."""
    ranges = []
    for text in networks:
        net = ipaddress.ip_network(text)
        low, high = int(net.network_address), int(net.broadcast_address)
        ends = (f"{low}L", f"{high}L") if net.version == 4 else (f"'{low:032x}'", f"'{high:032x}'")
        ranges.append(f"named_struct('low', {ends[0]}, 'high', {ends[1]})")
    table = F.expr(f"array({', '.join(ranges)})")
    return F.exists(table, lambda r: value.between(r["low"], r["high"]))


_V4 = r"^\d+\.\d+\.\d+\.\d+$"


def is_global_address(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is globally reachable, as an expression over the short fixed lists."""

    def v4(number: Column) -> Column:
        return ~_inside(number, fixed.NON_GLOBAL_V4) | _inside(number, fixed.GLOBAL_EXCEPTIONS_V4)

    def v6(digits: Column) -> Column:
        own = ~_inside(digits, fixed.NON_GLOBAL_V6) | _inside(digits, fixed.GLOBAL_EXCEPTIONS_V6)
        inner = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("bigint")
        mapped = ~_inside(inner, fixed.NON_GLOBAL_V4) | _inside(inner, fixed.GLOBAL_EXCEPTIONS_V4)
        return F.when(digits.startswith("00000000000000000000ffff"), mapped).otherwise(own)

    is_v4 = ip.rlike(_V4)
    return F.when(is_v4, let(_v4_number(F.when(is_v4, ip)), v4)).otherwise(
        let(v6_hex(F.when(~is_v4, ip)), v6)
    )


def address_bits(ip: Column) -> Column:
    """``4`` or ``6`` and the bits of an address, so that a network is what its addresses begin with."""
    is_v4 = ip.rlike(_V4)
    v4 = F.lpad(F.bin(_v4_number(F.when(is_v4, ip))), 32, "0")
    digits = F.when(~is_v4, F.nullif(v6_hex(F.when(~is_v4, ip)), F.lit("")))
    half = lambda part: F.lpad(F.conv(part, 16, 2), 64, "0")
    v6 = F.when(F.length(digits) == 32, F.concat(half(F.left(digits, F.lit(16))), half(F.right(digits, F.lit(16)))))
    return F.when(is_v4, F.concat(F.lit("4"), v4)).otherwise(F.concat(F.lit("6"), v6))


def fixed_networks(spark: SparkSession) -> DataFrame:
    """The reserved ranges as a table (network, acceptable); addresses outside are acceptable.

    The range that proxies use as stand-ins for public hosts is acceptable, but not as an IPv6 address of an IPv4 one.
    """
    v4 = dict.fromkeys(fixed.NON_GLOBAL_V4, False) | dict.fromkeys(fixed.GLOBAL_EXCEPTIONS_V4, True)
    v6 = dict.fromkeys(fixed.NON_GLOBAL_V6, False) | dict.fromkeys(fixed.GLOBAL_EXCEPTIONS_V6, True)
    mapped = {"::ffff:0:0/96": True}
    for network, acceptable in v4.items():
        address, _, size = network.partition("/")
        mapped[f"::ffff:{address}/{96 + int(size)}"] = acceptable
    every = v4 | {fixed.PROXY_FAKE_RANGE: True} | v6 | mapped
    return spark.createDataFrame(list(every.items()), "network string, acceptable boolean")


def address_verdicts(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds ``acceptable``, by the longest network that holds the address ``ip``; without one it is acceptable.

    ``networks`` (network as address/length, IPv4 and IPv6, acceptable): ranges and exceptions inside them; of equal ones a
    forbidding one wins. An address meets the table once for each length of prefix that occurs in it, at most 162, in an equi join on
    its first bits. An ip that is no address has no network; a null ip has a null verdict.
    """
    parts = F.split("network", "/")
    size = F.get(parts, F.lit(1)).cast("int")
    ranges = (
        networks.select(F.left(address_bits(F.get(parts, F.lit(0))), size + 1).alias("prefix"), size.alias("size"), "acceptable")
        .groupBy("prefix", "size").agg(F.bool_and("acceptable").alias("allows"))
    )
    shapes = ranges.select(F.left("prefix", F.lit(1)).alias("kind"), "size").distinct().collect()
    lengths = {kind: sorted(r["size"] for r in shapes if r["kind"] == kind) for kind in "46"}
    ips = addresses.select("ip").filter(F.col("ip").isNotNull()).distinct().withColumn("bits", address_bits(F.col("ip")))
    sizes = F.when(F.col("bits").startswith("4"), int_array(lengths["4"])).otherwise(int_array(lengths["6"]))
    prefixes = ips.select("ip", F.explode(F.transform(sizes, lambda n: F.left("bits", n + 1))).alias("prefix"))
    # The longest, with what it says, in one number: a hash aggregate keeps it.
    best = prefixes.join(ranges, "prefix").groupBy("ip").agg(F.max(F.col("size") * 2 + F.col("allows").cast("int")).alias("_best"))
    verdict = F.when(F.col("ip").isNotNull(), F.coalesce(F.col("_best") % 2 == 1, F.lit(True)))
    return addresses.join(best, "ip", "left").select(*addresses.columns, verdict.alias("acceptable"))


def resolved_hosts(dns: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """One row per host: whether any of its addresses is unacceptable.

    ``dns`` has (host, ip); a null ip means "no answer". ``networks`` is laid over the reserved ranges: what it says of
    a network counts in place of them. The aggregate is combined before the shuffle, so a host
    with many rows costs nothing extra.
    """
    ranges = fixed_networks(dns.sparkSession)
    if networks is not None:
        ranges = ranges.join(networks, "network", "left_anti").unionByName(networks.select("network", "acceptable"))
    return address_verdicts(dns.select("host", "ip"), ranges).groupBy("host").agg(
        F.count("ip").alias("n_addresses"), F.coalesce(F.bool_or(~F.col("acceptable")), F.lit(False)).alias("any_bad")
    )


def resolved_address_policy(hosts: DataFrame, dns: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """Adds ``error_code`` and ``retryable`` to rows with a ``host``; ``networks`` as for ``resolved_hosts``."""
    unresolved = F.coalesce(F.col("n_addresses"), F.lit(0)) == 0
    return (
        hosts.join(resolved_hosts(dns, networks), "host", "left")
        .withColumn(
            "error_code",
            F.when(unresolved, "platform_unavailable").when(F.col("any_bad"), "unsafe_url"),
        )
        .withColumn("retryable", unresolved)
        .drop("n_addresses", "any_bad")
    )
