import random

import numpy as np
import pytest

from mediasift.llm import url_cascade as u

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
SCHEMA = "page_id long, url string, html string, host string, keys long, h1 string"


def plain(url, rules, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def fits(rule):
        cut = rule.find("/") if "/" in rule else len(rule)
        return (host == rule[:cut] or host.endswith("." + rule[:cut])) and path.startswith(rule[cut:])

    best = max((r for r in rules if fits(r[0])), key=lambda r: (len(r[0]), r[0].split("/")[0].count("."), r[1] == "block"), default=None)
    if best:
        return host, path, *best
    return host, path, None, "block" if any(map(fits, listed)) else "allow"


def judge(spark, rows, rules, listed, **more):
    pages = spark.createDataFrame([(i, x, "", "a", 1, "b") for i, x in rows], SCHEMA)
    known = spark.createDataFrame([(k,) for k in listed], "key string")
    out = u.url_verdicts(pages, spark.createDataFrame(rules, "rule string, verdict string"), known, **more)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("bytes_", [u.CASCADE_BYTES, 300])
def test_many_keys_against_all_rules(spark, bytes_):
    pick = random.Random(3)
    host = lambda: ".".join(pick.choices(["a", "b", "c", "www", "xn--é"], k=pick.randint(1, 3))) + pick.choice([".com", ".org", ".net"])
    path = lambda: "".join(pick.choices(["/", "d", "e/", "/fr"], k=pick.randint(0, 4)))
    key = lambda: host() + (p if (p := path()).startswith("/") else "")
    rules = {key(): pick.choice(["allow", "block"]) for _ in range(60)}
    listed = sorted({key() for _ in range(120)})
    rows = [(i, f"http://{host()}{p if (p := path()).startswith('/') else '/' + p}{pick.choice(['', '?q=/a', '#x'])}") for i in range(600)]
    want = sorted(((i, *plain(x, list(rules.items()), listed)) for i, x in rows), key=str)
    assert judge(spark, rows, list(rules.items()), listed, cascade_bytes=bytes_) == want
    assert {r[-1] for r in want} == {"allow", "block"} and any(r[3] for r in want)


def test_odd_rows(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://ORG/x", "http://x.EXAMPLE.org/es/1", "http://example.org/es",
        "http://notexample.org/es/", "http://example.org/en/199", "http://example.org?/es/", "http://a..com/fr/", "http://b.com/de/#x://y.org/",
        "ftp://u@p.com:80/fr/é", "http://z.org/" + "é" * 20000, "http://" + "a." * 5000 + "org/", "x://y://z.org/", "http://bad.net/", "http://sub.bad.net",
    ]
    rows = list(enumerate(urls)) + [(None, "http://q.org/"), (6, "http://org/"), (6, "http://org/")]
    want = sorted(((i, *plain(x, RULES, ["bad.net"])) for i, x in rows), key=str)
    assert judge(spark, rows, RULES, ["bad.net", None]) == want


def test_empty_tables(spark):
    assert judge(spark, [], RULES, ["bad.net"]) == []
    assert judge(spark, [(1, "http://a.org/")], [], []) == [(1, "a.org", "/", None, "allow")]
    assert judge(spark, [(1, "http://a.org/")], [(None, "block"), ("a.org", None)], []) == [(1, "a.org", "/", None, "allow")]


def test_rule_for_both_blocks(spark):
    assert judge(spark, [(1, "http://a.org/")], [("org/", "allow"), ("org/", "block")], [])[0][3:] == ("org/", "block")


def test_cascade_is_exact_where_one_filter_is_not(spark):
    """Coarse filters: several levels, no wrong answer for any key of the universe."""
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key", "id")
    keys = keys.withColumns(u.hashed(keys["key"]))
    listed = keys.filter("id % 7 = 0").selectExpr("'listed' AS list", "key", "h1", "h2")
    cascade = u.build(listed, keys.select("key", "h1", "h2"), 20_000)["listed"]
    rows = keys.toPandas()
    h1, h2 = rows.h1.to_numpy(), rows.h2.to_numpy()
    assert (cascade.member(h1, h2) == (rows.id % 7 == 0)).all()
    assert len(cascade.levels) >= 3
    assert (cascade.levels[0].passes(h1, h2, 0) & (rows.id % 7 != 0)).any()
    assert sum(len(x.bits) for x in cascade.levels) * 64 / 20_000 < 8
    assert not u.Cascade().member(h1[:3], h2[:3]).any() and np.array_equal(u.Cascade().member(h1[:0], h2[:0]), [])
