import io
from collections import defaultdict

import pytest

from mediasift.llm import archives as a
from mediasift.session import work_dir

SCHEMA = "page_id long, url string, html string, id string, file string"


def test_pages_come_back(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i % 40}</p>", "", "") for i in range(200)]
    pages += [(300, None, None, "", ""), (301, "", "", "", ""), (None, "u v", "<p>1</p>", "", ""), (302, "é\n", "ß" * 500_000, "", ""), (302, "w", "ß" * 500_000, "", "")]
    got = a.page_records(spark, spark.createDataFrame(pages, SCHEMA).repartition(3)).collect()
    groups = defaultdict(list)
    for page_id, _, html, *_ in pages:
        groups[html or ""].append(page_id)
    want = []
    for html, ids in groups.items():
        ids.sort(key=lambda x: -1 if x is None else x)
        for i in ids[:-1]:
            want.append((i, len(html.encode()), a.digest(html.encode()), "revisit", ids[-1]))
        want.append((ids[-1], len(html.encode()), a.digest(html.encode()), "response", None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_both_versions_are_parsed():
    block = a.http_block(7, b"<p>\n\nx</p>")
    values = {"URL": "http://a b/c", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html", "Result-code": "200"}
    for version in (1, 2):
        data = a.arc_head(version, "f.arc") + a.arc_record(version, values, block) + a.arc_record(version, values, b"")
        (one, body), (_, empty) = a.arc_records(a.Stream(io.BytesIO(data), chunk=7))
        assert one["URL"] == "http://a b/c" and body == block and empty == b""
        warc = a.to_warc("f.arc", 0, one, body, None)
        ((head, kept),) = a.warc_records(a.Stream(io.BytesIO(warc), chunk=5))
        assert kept == block and head["warc-date"] == "2001-02-03T04:05:06Z" and head["warc-type"] == "response"
        assert head["warc-ip-address"] == "1.2.3.4" and head["warc-payload-digest"] == "sha1:" + a.digest(b"<p>\n\nx</p>")
    assert list(a.arc_records(a.Stream(io.BytesIO(b"")))) == []


def test_broken_files_are_reported():
    values = {"URL": "u", "IP-address": "-", "Archive-date": "1999", "Content-type": "t"}
    whole = a.arc_head(1, "f") + a.arc_record(1, values, b"body")
    with pytest.raises(ValueError, match="ends inside"):
        list(a.arc_records(a.Stream(io.BytesIO(whole[:-4]))))
    with pytest.raises(ValueError, match="not an ARC header"):
        list(a.arc_records(a.Stream(io.BytesIO(a.arc_head(1, "f") + b"u t x\n"))))
    assert a.iso_date("1999") == "1999-01-01T00:00:00Z" and a.iso_date("?") == "1970-01-01T00:00:00Z"


def test_empty_table_and_small_payloads(spark):
    assert a.page_records(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    folder, out = work_dir(spark, "arc"), work_dir(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "same", "", ""), (2, "u", "same", "", "")], SCHEMA)
    files = a.convert(a.write_arc(pages, folder, versions=(2,)), folder, out, least_bytes=5)
    assert {r["record_type"] for r in a.read_warc(files, out).collect()} == {"response"}


def test_as_many_tasks_as_files(spark):
    """The index of a file is small; still each file is converted by a task of its own."""
    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://x.org/', id) AS url", "concat('<p>', id % 9) AS html").repartition(5)
    arcs, warcs = work_dir(spark, "test-arc"), work_dir(spark, "test-warc")
    files = a.write_arc(pages, arcs)
    assert files.count() == 10
    narrow = a.decide(a.arc_index(files, arcs)).select("file", "place")
    parts = a._one_a_task(narrow, files).groupBy("file").agg({"place": "max"})
    assert parts.rdd.getNumPartitions() == 10
    assert a.read_warc(a.convert(files, arcs, warcs), warcs).count() == 200
