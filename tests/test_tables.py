"""Stored inputs that meet without an exchange."""

import pytest

from mediasift.operators.manifest import explode_artifacts, verify_manifest
from mediasift.plans.analyze import analyze_content
from mediasift.sources.tables import save_bucketed

from .test_operators import ENGINES, SHA, request, seen


@pytest.fixture
def stored(spark, tmp_path):
    names = []

    def save(rows, name, key):
        save_bucketed(rows, name, key, 8, str(tmp_path / name))
        names.append(name)
        return spark.table(name)

    yield save
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_analysis_of_bucketed_inputs_has_no_exchange(spark, stored):
    posts = request(spark, *[{"request_id": i, "post_text": f"text {i}", "artifacts": [("a.png", 1, SHA, None)]} for i in range(40)])
    found = seen(spark, *[{"request_id": i} for i in range(40)])
    replies = spark.createDataFrame([(i, None, None) for i in range(40)], "request_id long, reply string, error string")
    inputs = [("stored_requests", posts), ("stored_observations", found), ("stored_replies", replies)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(analyze_content(posts, found, replies, ENGINES)) > 0
        out = analyze_content(*(stored(rows, name, "request_id") for name, rows in inputs), ENGINES)
        assert exchanges(out) == 0
        want = analyze_content(posts, found, replies, ENGINES)
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_manifest_meets_bucketed_files_with_one_exchange(spark, stored):
    posts = request(spark, *[{"request_id": i, "artifacts": [(f"a{i}.png", 1, SHA, None)]} for i in range(40)])
    files = spark.createDataFrame([(f"/m/a{i}.png", 1, SHA, True) for i in range(30)], "path string, length long, sha256 string, is_regular boolean")
    rows = explode_artifacts(posts).select("request_id", "artifact_index", "path", "size_bytes", "sha256")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(verify_manifest(rows, files, "/m")) == 2
        out = verify_manifest(rows, stored(files, "stored_files", "path"), "/m")
        assert exchanges(out) == 1
        assert out.filter("error IS NULL").count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_second_scan_hashes_what_has_changed(spark, tmp_path):
    import hashlib
    import os

    from mediasift.sources.files import snapshot

    for name in ("same.jpg", "longer.jpg", "touched.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    os.symlink(tmp_path / "same.jpg", tmp_path / "link.jpg")
    first = {r["path"].rsplit("/", 1)[1]: r for r in snapshot(spark, str(tmp_path)).collect()}
    assert first["link.jpg"]["sha256"] is None and first["same.jpg"]["sha256"] == hashlib.sha256(b"same.jpg").hexdigest()
    # A marked hash shows where it was reused.
    schema = "path string, size_bytes long, modified long, is_regular boolean, sha256 string"
    known = spark.createDataFrame([(r["path"], r["size_bytes"], r["modified"], r["is_regular"], "kept " + r["path"][-8:]) for r in first.values() if r["sha256"]], schema)
    (tmp_path / "longer.jpg").write_bytes(b"much longer")
    (tmp_path / "touched.jpg").write_bytes(b"TOUCHED.jpg")
    os.utime(tmp_path / "touched.jpg", (5, 5))
    (tmp_path / "new.jpg").write_bytes(b"new")
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in snapshot(spark, str(tmp_path), known).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"same.jpg": "kept same.jpg", "longer.jpg": sha(b"much longer"), "touched.jpg": sha(b"TOUCHED.jpg"), "new.jpg": sha(b"new"), "link.jpg": None}


def test_scan_query_has_size_and_hash_of_every_table(spark):
    import hashlib
    from pathlib import Path

    from mediasift.suite.load import QUERIES

    from .conftest import SMALL

    got = {r["path"]: (r["size_bytes"], r["sha256"]) for r in QUERIES["scan_artifacts"](spark, SMALL).collect()}
    assert got == {f"{p.parent.name}/{p.name}": (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(SMALL).glob("*.parquet")}
