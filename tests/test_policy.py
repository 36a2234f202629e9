"""Allowlists and networks as tables."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from mediasift import fixed
from mediasift.operators import policy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_allowlist_of_many_domains(spark):
    pick = random.Random(2)
    allowed = sorted({f"d{pick.randrange(200_000)}.example.{pick.choice(['com', 'org'])}" for _ in range(100_000)})
    hosts = [f"{pick.choice(['', 'www.', 'a.b.', 'not'])}{pick.choice(allowed)}" for _ in range(300)]
    hosts += [f"d{pick.randrange(200_000)}.example.net" for _ in range(50)]
    rows = [(i, f"https://{h}/x") for i, h in enumerate(hosts)] + [(1000, "http://d1.example.com/"), (1001, None), (1002, f"https://u:p@{allowed[0]}/")]
    known = set(allowed)

    def error(url):
        if not url or not url.startswith("https://") or "@" in url:
            return "unsafe_url"
        labels = url[8:].split("/")[0].split(".")
        return None if any(".".join(labels[i:]) in known for i in range(len(labels))) else "permission_denied"

    got = policy.url_policy(
        spark.createDataFrame(rows, "request_id int, url string"), spark.createDataFrame([(d,) for d in allowed], "domain string")
    )
    assert {r["request_id"]: r["error_code"] for r in got.collect()} == {i: error(u) for i, u in rows}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


@pytest.mark.parametrize("allowed", [[], None])
def test_empty_allowlist_is_an_error(spark, allowed):
    urls = spark.createDataFrame([(1, "https://a.org")], "request_id int, url string")
    with pytest.raises(ValueError, match="empty"):
        policy.url_policy(urls, spark.createDataFrame([], "domain string") if allowed is None else allowed)


def plain_verdict(ip, networks):
    address = ipaddress.ip_address(ip)
    held = [n for n in networks if ipaddress.ip_network(n[0]).version == address.version and address in ipaddress.ip_network(n[0])]
    if not held:
        return True
    longest = max(ipaddress.ip_network(n).prefixlen for n, _ in held)
    return all(ok for n, ok in held if ipaddress.ip_network(n).prefixlen == longest)


def test_longest_network_wins(spark):
    pick = random.Random(6)
    v4 = lambda: ipaddress.ip_address(pick.choice([10 << 24, 8 << 24, 0, 255 << 24]) + pick.randrange(1 << 20))
    v6 = lambda: ipaddress.ip_address((pick.choice([0x20010DB8, 0xFD000000, 0]) << 96) + (pick.randrange(1 << 16) << 80) + pick.randrange(1 << 16))
    ips = [str(v4()) for _ in range(200)] + [str(v6()) for _ in range(200)] + ["::1", "::", "255.255.255.255", "0.0.0.0"]
    networks = {}
    for ip in pick.choices(ips, k=60):
        size = pick.randint(0, 32 if "." in ip else 128)
        networks[str(ipaddress.ip_network(f"{ip}/{size}", strict=False))] = pick.random() < 0.5
    rows = list(networks.items()) + [(next(iter(networks)), False)]
    table = spark.createDataFrame(rows, "network string, acceptable boolean")
    got = policy.address_verdicts(spark.createDataFrame([(ip, 1) for ip in ips] + [(None, 2), ("no address", 3)], "ip string, n int"), table)
    found = {r["ip"]: r["acceptable"] for r in got.collect()}
    assert {ip: found[ip] for ip in ips} == {ip: plain_verdict(ip, rows) for ip in ips}
    assert found[None] is None and found["no address"] is True
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_fixed_networks_agree_with_the_expression(spark):
    ips = ["8.8.8.8", "10.0.0.1", "192.0.0.9", "192.0.0.8", "198.18.0.1", "255.255.255.255", "2001:db8::1", "2001:4:112::1", "fe80::1", "::1",
           "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:198.18.0.1", "::ffff:192.0.0.9", "2606:4700::1111"]
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string").withColumn("g", policy.is_global_address(F.col("ip")))
    got = policy.address_verdicts(rows, policy.fixed_networks(spark)).collect()
    proxy = ipaddress.ip_network(fixed.PROXY_FAKE_RANGE)
    for r in got:
        address = ipaddress.ip_address(r["ip"])
        assert r["acceptable"] == (r["g"] or address.version == 4 and address in proxy), r


def test_user_networks_lie_over_the_fixed_ones(spark):
    dns = spark.createDataFrame([("a", "10.0.0.5"), ("b", "10.0.0.6"), ("c", "8.8.8.8"), ("d", None)], "host string, ip string")
    own = spark.createDataFrame([("10.0.0.0/8", True), ("10.0.0.6/32", False), ("8.8.8.0/24", False)], "network string, acceptable boolean")
    got = {r["host"]: (r["n_addresses"], r["any_bad"]) for r in policy.resolved_hosts(dns, own).collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (1, True), "d": (0, False)}
