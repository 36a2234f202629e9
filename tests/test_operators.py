"""Operators on hand rows, against plain restatements, and under skew."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from mediasift.functions.hashing import Engines
from mediasift.functions.replies import parse_semantic_payload
from mediasift.operators import cache, contracts, keywords, manifest, plugins, policy, progress, records, sampling, throttle
from mediasift.operators.blocks import in_blocks
from mediasift.plans.analyze import analyze_content
from mediasift.plans.ingest import ingest_media, media_items
from mediasift.plans.run_analysis import analysis_audit, cache_puts, run_analysis
from mediasift.schemas import MEDIA_INFO, OBSERVATION, REQUEST, REQUEST_DEFAULTS
from mediasift.sources.files import file_table, scan_artifacts, scan_images
from mediasift.sources.requests import read_requests
from mediasift.sources.tables import put_cache, read_cache
from mediasift.streaming import jobs


def request(spark, *rows):
    full = [{**{f: None for f in REQUEST.fieldNames()}, **REQUEST_DEFAULTS, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in REQUEST.fieldNames()) for r in full], REQUEST)


def seen(spark, *rows):
    full = [{"artifact_index": 1, "decodable": True, **r} for r in rows]
    names = ["request_id", *OBSERVATION.fieldNames()]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("request_id", T.LongType()), *OBSERVATION.fields])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema)


SHA = "ab" * 32
POST = "周末市集开张，欢迎来玩"
ENGINES = Engines(ocr="fake-ocr", asr="fake-asr", vision="fake-vlm")


def image_request(spark, **changes):
    return request(
        spark,
        {"request_id": 1, "post_text": POST, "artifacts": [("in/shot.png", 3, SHA.upper(), "image/png")], **changes},
    )


def ocr_seen(spark):
    return seen(spark, {"request_id": 1, "width": 640, "height": 480, "ocr_lines": ["手作摊位", " 成都 ", "成都"]})


def test_analysis_with_a_model_answer(spark):
    reply = {
        "language": "zh", "summary": "成都的周末市集开张了。", "topics": ["市集"], "entities": ["成都"],
        "claims": ["市集每周六开门"], "image_summary": "一排手作摊位", "sentiment": "neutral",
        "commercial_intent": "event_notice", "confidence": 0.84, "evidence_refs": ["post-text-1", "ocr-1-1", "x"],
    }
    replies = spark.createDataFrame([(1, json.dumps(reply), None)], "request_id long, reply string, error string")
    row = analyze_content(image_request(spark), ocr_seen(spark), replies, ENGINES).first()
    out = row["output"]
    assert row["error_code"] is None
    assert out["summary"] == "成都的周末市集开张了。" and out["entities"] == ["成都"]
    assert out["assets"][0]["ocr_text"] == ["手作摊位", "成都"]
    assert (out["assets"][0]["width"], out["assets"][0]["artifact_sha256"]) == (640, SHA)
    assert out["needs_human_review"] is False
    assert [(t["namespace"], t["label"]) for t in out["tags"]] == [
        ("topic", "市集"), ("entity", "成都"), ("format", "image"), ("sentiment", "neutral"),
        ("commercial", "event_notice"),
    ]
    assert out["tags"][0]["evidence_refs"] == ["post-text-1", "ocr-1-1", "visual-model-1"]
    assert [e["evidence_id"] for e in out["evidence"]] == ["post-text-1", "ocr-1-1", "ocr-1-2", "visual-model-1"]


def test_analysis_without_a_model(spark):
    row = analyze_content(image_request(spark), ocr_seen(spark), None, Engines(ocr="fake-ocr")).first()
    out = row["output"]
    assert "手作摊位" in out["summary"] and out["confidence"] == 0.5 and out["needs_human_review"] is True
    assert out["warnings"] == ["Semantic model is not configured; returned deterministic OCR/ASR analysis."]
    assert out["claims"] == [POST] and out["language"] == "zh"


def test_a_failing_model_and_no_text(spark):
    replies = spark.createDataFrame([(1, None, "TimeoutError")], "request_id long, reply string, error string")
    rows = request(
        spark,
        {"request_id": 1, "artifacts": [("a.mp4", 1, SHA, None), ("b.txt", 1, SHA, None), ("c.png", 1, SHA, None)]},
    )
    found = seen(
        spark,
        {"request_id": 1, "artifact_index": 1, "duration_seconds": 9.0, "sampled_frame_count": 1},
        {"request_id": 1, "artifact_index": 3},
    )
    out = analyze_content(rows, found, replies, Engines(vision="m")).first()["output"]
    assert out["summary"] == "Downloaded video and image content; no textual evidence was extracted."
    assert (out["confidence"], out["language"], out["topics"]) == (0.3, "unknown", [])
    assert out["warnings"] == [
        "Skipped unsupported ancillary artifact: b.txt",
        "OCR is not installed or has been disabled.",
        "Speech recognition is not installed or has been disabled.",
        "Semantic model failed; deterministic fallback used (TimeoutError).",
    ]


def test_output_caps_fail_the_whole_request(spark):
    rows = request(
        spark,
        {"request_id": 1, "post_text": "x" * 10_001, "artifacts": [("a.png", 1, SHA, None)]},
        {"request_id": 2, "post_text": "x", "artifacts": [("a.bin", 1, SHA, None)]},
        {"request_id": 3, "post_text": "x", "artifacts": [("a.mp4", 1, SHA, None)]},
        {"request_id": 4, "post_text": "a" * 201, "artifacts": [("a.png", 1, SHA, None)]},
        {"request_id": 5, "post_text": "fine text", "artifacts": [("a.png", 1, SHA, None)], "generate_tags": False, "generate_summary": False},
    )
    found = seen(
        spark, {"request_id": 1}, {"request_id": 2}, {"request_id": 3, "duration_seconds": 3601.0}, {"request_id": 4}, {"request_id": 5}
    )
    got = {r["request_id"]: r for r in analyze_content(rows, found).collect()}
    codes = {k: r["error_code"] for k, r in got.items()}
    assert codes == {1: "analysis_failed", 2: "unsupported_media", 3: "limit_exceeded", 4: "analysis_failed", 5: None}
    out = got[5]["output"]
    assert (out["summary"], out["tags"], out["topics"], out["claims"]) == ("", [], [], ["fine text"])
    # Late filters do not multiply the work above them.
    assert analyze_content(rows, found).filter(F.col("error_code").isNull()).count() == 1


def test_files_of_any_name_but_no_links(spark, tmp_path):
    deep = tmp_path / "_a" / ".b"
    deep.mkdir(parents=True)
    kept = {"_x.jpg": b"one", ".x.jpg": b"two", "plain.png": b"three" * 500_000, "empty.jpg": b"", ".x.crc": b"4", ".part": b"5"}
    for name, content in kept.items():
        (tmp_path / name).write_bytes(content)
        (deep / name).write_bytes(content)
    (tmp_path / "half.part").write_bytes(b"x")
    (tmp_path / "link.jpg").symlink_to(tmp_path / "_x.jpg")
    (tmp_path / "broken.jpg").symlink_to(tmp_path / "gone.jpg")
    (tmp_path / "loop").symlink_to(tmp_path)
    want = sorted((f"{d}/{n}", len(c), hashlib.sha256(c).hexdigest()) for d in (tmp_path, deep) for n, c in kept.items())
    scanned = scan_artifacts(spark, str(tmp_path))
    assert sorted(tuple(r) for r in scanned.select("path", "size_bytes", "sha256").collect()) == want
    files = file_table(spark, str(tmp_path))
    assert {r["path"]: r["sha256"] for r in files.filter("NOT is_regular").collect()} == {f"{tmp_path}/link.jpg": None}
    assert files.count() == len(want) + 1
    sha = hashlib.sha256(b"one").hexdigest()
    arts = spark.createDataFrame(
        [(1, 1, "_x.jpg", 3, sha), (2, 1, "link.jpg", 3, sha), (3, 1, "_a/.b/.x.jpg", 3, sha)],
        "request_id int, artifact_index int, path string, size_bytes long, sha256 string",
    )
    ranks = {r["request_id"]: r["error"] and r["error"]["rank"] for r in manifest.verify_manifest(arts, files, str(tmp_path)).collect()}
    assert ranks == {1: None, 2: 3, 3: 5}
    # The same through a store that only Spark reads.
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    (tmp_path / "link.jpg").unlink()
    (tmp_path / "loop").unlink()
    stored = scan_artifacts(spark, "viewfs://files/in").select("path", "size_bytes", "sha256")
    # The local store below hides checksum files of its own.
    assert sorted(tuple(r) for r in stored.collect()) == [
        (p.replace(str(tmp_path), "viewfs://files/in"), n, h) for p, n, h in want if not p.endswith(".crc")
    ]


def test_files_cache_and_audit_end_to_end(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    (root / "post.jpg").write_bytes(b"image-content")
    (root / "half.part").write_bytes(b"x")
    (tmp_path / "secret.jpg").write_bytes(b"secret")
    files = file_table(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["post.jpg", "secret.jpg"]
    size, sha = scan_artifacts(spark, str(root)).select("size_bytes", "sha256").first()
    rows = request(
        spark,
        {"request_id": 1, "artifacts": [("post.jpg", size, sha, None)]},
        {"request_id": 2, "artifacts": [(f"{root}/./post.jpg", size, sha.upper(), None)]},
        {"request_id": 3, "artifacts": [("../secret.jpg", 6, sha, None)]},
        {"request_id": 4, "artifacts": [("post.jpg", size, "0" * 64, None)]},
        {"request_id": 5, "artifacts": [("gone.jpg", size, sha, None), ("post.jpg", size, "0" * 64, None)]},
        {"request_id": 6, "artifacts": [("post.jpg", size, sha, None)], "force_reanalyze": True},
        {"request_id": 7, "artifacts": []},
        {"request_id": 8, "artifacts": [("post.jpg", size + 1, sha, None)]},
    )
    found = seen(spark, *[{"request_id": i} for i in range(1, 9)])
    first = run_analysis(rows, files, found, root=str(root)).cache()
    got = {r["request_id"]: r for r in first.collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {
        1: None, 2: None, 3: "invalid_artifact", 4: "hash_mismatch", 5: "invalid_artifact", 6: None,
        7: "invalid_request", 8: "invalid_artifact",
    }
    assert {k for k, r in got.items() if r["computed"]} == {1, 6}
    assert got[2]["output"]["cache_hit"] is True and got[1]["output"]["cache_hit"] is False
    assert "outside" in got[3]["message"]

    put_cache(cache_puts(first), str(tmp_path / "cache"), 0)
    second = run_analysis(rows, files, found, root=str(root), cache=read_cache(spark, str(tmp_path / "cache")))
    again = {r["request_id"]: r for r in second.collect()}
    assert {k for k, r in again.items() if r["computed"]} == {6}
    assert again[1]["output"]["cache_hit"] is True
    events = analysis_audit(second).collect()
    assert len(events) == 8 and sum(e["event_type"] == "tool.failed" for e in events) == 5
    assert all((e["output_hash"] is None) == (e["error_code"] is not None) for e in events)


def test_images(spark, tmp_path):
    def bitmap(width, height, value):
        row = bytes([value(x)[c] for x in range(width) for c in range(3)])
        row += b"\0" * (-len(row) % 4)
        body = row * height
        head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
        return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body

    (tmp_path / "a.bmp").write_bytes(bitmap(32, 16, lambda x: (255, 255, 255) if x < 16 else (0, 0, 0)))
    (tmp_path / "b.png").write_bytes(b"no image")
    images = scan_images(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in plugins.image_ahash(images).drop("image").collect()}
    assert (got["a.bmp"]["width"], got["a.bmp"]["height"], got["a.bmp"]["error_code"]) == (32, 16, None)
    assert got["a.bmp"]["perceptual_hash"] == "ahash:" + "f0" * 8
    assert (got["b.png"]["width"], got["b.png"]["error_code"]) == (None, "unsupported_media")


def test_throttle_equals_the_loop_whatever_the_blocks(spark):
    rng = random.Random(3)
    calls = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), rng.randint(0, 4000)) for i in range(900)]
    expected, last = {}, {}
    for call_id, key, ts in sorted(calls, key=lambda c: (c[2], c[0])):
        last[key] = expected[call_id] = max(ts, last[key] + 7) if key in last else ts
    rows = spark.createDataFrame(calls, "call_id long, key string, ts long")
    odd = spark.createDataFrame([(-1, None, 5), (-2, "a", None), (-3, "late", 10**15)], rows.schema)
    got = throttle.throttle_schedule(rows.unionByName(odd), 7).collect()
    assert {r["call_id"]: r["admit"] for r in got} == expected | {-1: None, -2: None, -3: 10**15}


def test_one_wrong_clock_makes_no_block_large(spark):
    rows = spark.range(20_000).selectExpr("'k' AS key", "IF(id = 7, 4000000000000000, id) AS ts", "id AS call_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = in_blocks(rows, ["key"], ["ts", "call_id"]).groupBy("_block").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(b["count"] for b in blocks) < 9_000


def test_caps_are_the_callers(spark):
    rows = spark.range(150).selectExpr("1 AS request_id", "id AS path", "150 AS cap")
    assert records.cap_items(rows, F.col("cap"), "path").count() == 150


def test_stream_analysis_reuses_earlier_batches(spark, tmp_path):
    files = spark.createDataFrame([("/m/a.png", 1, SHA, True)], "path string, length long, sha256 string, is_regular boolean")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (0, 1):
        rows = request(
            spark, *[{"request_id": batch * 2 + i, "post_text": "same", "artifacts": [("a.png", 1, SHA, None)]} for i in (0, 1)]
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        found = seen(spark, *[{"request_id": i} for i in range(4)])
        stream = spark.readStream.schema(REQUEST).parquet(source)
        jobs.stream_analyze(stream, files, found, root="/m", folder=out).awaitTermination()
    got = spark.read.parquet(f"{out}/results").select("request_id", "computed", "output.cache_hit").collect()
    assert {r["request_id"]: (r["computed"], r["cache_hit"]) for r in got} == {
        0: (True, False), 1: (False, True), 2: (False, True), 3: (False, True),
    }
    assert spark.read.parquet(f"{out}/audit").count() == 4


def test_even_samples_of_hot_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("few", i) for i in range(3)] + [("none", 7)]
    df = spark.createDataFrame(rows, "g string, t long")
    for cap in (1, 4, 24):
        got = sampling.evenly_sample_rows(df, ["g"], ["t"], cap).collect()
        by = {}
        for r in sorted(got, key=lambda r: r["sample_no"]):
            by.setdefault(r["g"], []).append(r["t"])
        picks = [250] if cap == 1 else [round(i * 499 / (cap - 1)) for i in range(cap)]
        assert by["hot"] == picks
        assert by["few"] == ([1] if cap == 1 else [0, 1, 2]) and by["none"] == [7]


def test_flatten_any_depth(spark):
    def nest(depth):
        return {"entries": [nest(depth - 1), 5, {"id": f"x{depth}"}]} if depth else {"id": "leaf"}

    raws = [nest(k) for k in range(9)] + [{"id": "s", "entries": "no"}, {"entries": []}, {"id": "n", "entries": None}]

    def leaves(node):
        if isinstance(node.get("entries"), list):
            return [x for e in node["entries"] if isinstance(e, dict) for x in leaves(e)]
        return [node["id"]]

    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(99, "{bad")], "request_id int, raw string")
    flat = records.flatten_entries(df.select("request_id", F.try_parse_json("raw").alias("record")))
    got = {}
    for r in flat.select("request_id", "path", F.try_variant_get("record", "$.id", "string").alias("id")).orderBy("request_id", "path").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    assert got == {i: leaves(r) for i, r in enumerate(raws) if leaves(r)}


def test_records_are_looked_at_once_and_opened_to_the_end(spark):
    deep = {"id": "bottom"}
    for k in range(3 * records.FIRST_LEVELS):
        deep = {"id": f"n{k}", "entries": [deep]}
    rows = spark.createDataFrame([(1, json.dumps({"entries": [{"id": "a", "note": "\"entries\""}, deep]}))], "request_id int, raw string")
    flat = records.flatten_entries(rows.select("request_id", F.try_parse_json("raw").alias("record")))
    # One look at the root, and one at each child in the first levels and in the others.
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(") <= 3
    assert [r["id"] for r in flat.orderBy("path").select(F.try_variant_get("record", "$.id", "string").alias("id")).collect()] == ["a", "bottom"]


def test_only_records_of_requests_that_may_have_items_are_opened(spark):
    rows = spark.createDataFrame([(1, 5, 100)], "request_id long, max_items int, max_duration_seconds int")
    raw = spark.range(9).select(
        F.col("id").alias("request_id"), F.lit(1).alias("url_index"), F.lit("u").alias("source_url"), F.try_parse_json(F.lit('{"id":1}')).alias("record")
    )
    items = media_items(rows, raw)
    plan = items._jdf.queryExecution().optimizedPlan().toString().splitlines()
    opened = min(i for i, line in enumerate(plan) if "Generate" in line)
    assert all(i > opened for i, line in enumerate(plan) if "Join" in line)
    assert [r["request_id"] for r in items.collect()] == [1]


def test_normalized_record(spark):
    raw = {"id": "c-9", "extractor_key": "Harbor", "title": "Boats at noon", "uploader": "mona", "upload_date": "20250317",
           "duration": 31.25, "view_count": 640, "webpage_url": "https://clips.example.org/b/9"}
    cols = records.normalize_media_info(F.try_parse_json(F.lit(json.dumps(raw))), F.lit("https://clips.example.org/b/9"))
    row = spark.range(1).select(*[cols[f.name].alias(f.name) for f in MEDIA_INFO.fields]).first()
    assert (row["media_id"], str(row["upload_date"]), row["duration_seconds"], row["view_count"]) == ("c-9", "2025-03-17", 31.25, 640)
    bare = records.normalize_media_info(F.try_parse_json(F.lit('{"id":0}')), F.lit(""))
    row = spark.range(1).select(bare["media_id"].alias("m"), bare["extractor"].alias("e"), bare["source_url"].alias("s")).first()
    assert (row["m"], row["e"], row["s"]) == ("e3b0c44298fc1c149afbf4c8", "unknown", "")


def test_original_images(spark):
    marks = ["one!nd_prv_q", "one!nd_dft_q", "two!nd_dft_q", "three!nd_prv_q"]
    raw = {"extractor_key": "XiaoHongShu", "thumbnail": "https://img/c", "thumbnails": [{"id": i, "url": f"https://img/{m}"} for i, m in enumerate(marks)]}
    got = spark.range(1).select(records.record_cover(F.try_parse_json(F.lit(json.dumps(raw)))).alias("c")).first()["c"]
    assert got == "https://img/two!nd_dft_q"


def test_ingest_refuses_and_limits(spark):
    rows = spark.createDataFrame(
        [(1, "t", ["https://a.example.com/x"], 1), (2, "t", ["https://a.example.com/y"], 2), (3, "t", ["https://evil.example/x"], 3),
         (4, "t", ["https://u:p@a.example.com/"], 4), (5, "t", ["https://b.example.com/", "https://a.example.com/"], 5),
         (6, "t", ["https://nowhere.example.com/"], 6), (7, "t", ["https://a.example.com/z"], 7)],
        "request_id long, tenant_id string, urls array<string>, ts long",
    )
    raw = spark.createDataFrame(
        [(i, 1, f"https://a.example.com/{i}" if i != 7 else "", f'{{"id":{i}}}') for i in (1, 2, 7)],
        "request_id long, url_index long, source_url string, raw string",
    ).withColumn("record", F.try_parse_json("raw")).drop("raw")
    files = spark.createDataFrame([(1, 10), (2, 600 * 1024 * 1024)], "request_id long, size_bytes long")
    dns = spark.createDataFrame(
        [("a.example.com", "8.8.8.8"), ("a.example.com", "198.18.0.72"), ("b.example.com", "8.8.8.8"), ("b.example.com", "127.0.0.1")],
        "host string, ip string",
    )
    outcomes, items = ingest_media(rows, raw, files, dns, ["example.com"], interval=10)
    got = {r["request_id"]: r for r in outcomes.collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {
        1: None, 2: "limit_exceeded", 3: "permission_denied", 4: "invalid_request", 5: "unsafe_url",
        6: "platform_unavailable", 7: "download_failed",
    }
    assert [got[k]["admit"] for k in (1, 2, 7)] == [1, 11, 21]
    # What the limits refuse is not read: it has no items to hash.
    assert got[1]["items_hash"] is not None and got[2]["items_hash"] is None
    assert [(r["request_id"], r["media_id"]) for r in items.collect()] == [(1, "1")]


def test_closed_schema(spark):
    lines = [
        '{"request_id":1,"post_text":"a"}', '{"request_id":2,"colour":1}', '{"request_id":3,"artifacts":[{"path":"a","x":1}]}',
        '{"request_id":"x"}', "nope", "[1]",
    ]
    rows = read_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = rows.select("request_id", "unknown_keys", "malformed").collect()
    assert [r["unknown_keys"] for r in got[:3]] == [[], ["colour"], ["x"]]
    assert [r["malformed"] for r in got] == [False, False, False, True, True, True]


def test_contract_edges(spark):
    good = {"request_id": 1, "artifacts": [("a", 0, SHA, None)]}
    cases = [
        (good, []), ({**good, "artifacts": [("", 0, SHA, None)]}, ["artifact_path"]), ({**good, "artifacts": [("a", -1, SHA, None)]}, ["artifact_size"]),
        ({**good, "artifacts": [("a", 0, SHA + "\n", None)]}, ["artifact_sha256"]), ({**good, "artifacts": [("a", 0, SHA, None)] * 101}, ["artifacts"]),
        ({**good, "source_url": "nope"}, ["source_url"]), ({**good, "max_keyframes": 121}, ["max_keyframes"]), ({**good, "language_hint": "x" * 33}, ["language_hint"]),
    ]
    rows = request(spark, *[{**c, "request_id": i} for i, (c, _) in enumerate(cases)])
    got = {r["request_id"]: r["violations"] for r in contracts.validate_analysis_requests(rows).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_hot_cache_key(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 != 0, F.lit("a" * 64)).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("cache_key")
    )
    marked = cache.mark_first(rows)
    assert marked.count() == 3000
    assert marked.filter("computes").count() == 1001
    assert marked.filter(F.col("computes") & (F.col("cache_key") == "a" * 64)).first()["request_id"] == 1


def test_parts_of_one_huge_request_count_like_one_text(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "新品", "delta-1", "with"]
    texts = [" ".join(rng.choices(words, k=9)) for _ in range(300)]
    parts = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "request_id int, part_no int, text string")
    got = [r["word"] for r in keywords.top_words_of_parts(parts, 4).orderBy("rank").collect()]
    whole = spark.createDataFrame([(1, " ".join(texts))], "request_id int, text string")
    assert got == [r["word"] for r in keywords.keyword_rows(whole, "text", 4).orderBy("rank").collect()]


def test_plug_ins(spark):
    images = spark.createDataFrame([(1, bytearray(b"a\nb")), (2, bytearray(b"bad"))], "i int, content binary")

    def factory():
        def read(content):
            if content == b"bad":
                raise ValueError
            return [[[[0, 0]], (content.decode(), 0.9)]]

        return read

    got = {r["i"]: (r["ocr_lines"], r["ocr_error"]) for r in plugins.ocr_udf(images, factory, "i").collect()}
    assert got == {1: (["a\nb"], None), 2: ([], "ValueError")}
    shapes = [
        '[[[[3,4],[5,6]],["menu",0.7]]]', '{"res":{"rec_texts":["soup","rice"]}}', '{"p":{"text":"k"},"q":[{"rec_text":["l","m"]}]}',
        '{"text":"t","a":{"text":"u"}}', '["s",1]', "[1,2]", "null", "broken",
    ]
    rows = spark.createDataFrame(list(enumerate(shapes)), "i int, result string")
    found = {r["i"]: r["ocr_lines"] for r in plugins.ocr_texts(rows).collect()}
    assert [found[i] for i in range(8)] == [["menu"], ["soup", "rice"], ["k", "l", "m"], ["t"], ["s"], [], [], []]


def test_wide_platform_lookup_keeps_rows(spark):
    rows = spark.createDataFrame([("https://m.youtube.com/a",), ("https://notyoutube.com",), ("x",)], "url string")
    got = {r["url"]: r["platform"] for r in policy.classify_platform(rows).collect()}
    assert got == {"https://m.youtube.com/a": "youtube", "https://notyoutube.com": None, "x": None}


def test_first_error_order(spark):
    arts = spark.createDataFrame(
        [(1, 1, "a", 1, SHA), (1, 2, "b", 9, SHA), (2, 1, "a", 1, "00" * 32), (2, 2, "gone", 1, SHA)],
        "request_id int, artifact_index int, path string, size_bytes long, sha256 string",
    )
    files = spark.createDataFrame([("/r/a", 1, SHA, True), ("/r/b", 1, SHA, True)], "path string, length long, sha256 string, is_regular boolean")
    got = {r["request_id"]: r["first"]["code"] for r in manifest.first_error(manifest.verify_manifest(arts, files, "/r")).collect()}
    assert got == {1: "invalid_artifact", 2: "hash_mismatch"}


def test_reply_with_fence(spark):
    text = "```json\n" + json.dumps({"topics": ["a"], "confidence": 1}) + "\n```"
    row = spark.createDataFrame([(text,)], "r string").select(parse_semantic_payload("r").alias("s")).first()["s"]
    assert row["topics"] == ["a"] and row["confidence"] == 1.0


def test_an_over_long_segment_is_a_failed_recognition(spark):
    rows = request(
        spark, *({"request_id": i, "post_text": "boats", "transcribe_audio": True, "artifacts": [("in/talk.mp3", 3, SHA, "audio/mpeg")]} for i in (1, 2))
    )
    found = seen(
        spark, {"request_id": 1, "segments": [(0.0, 1.0, "w" * 20_001)]}, {"request_id": 2, "segments": [(0.0, 1.0, "short talk")]}
    )
    got = {r["request_id"]: r for r in analyze_content(rows, found, None, ENGINES).collect()}
    assert [got[i]["error_code"] for i in (1, 2)] == [None, None]
    asset = got[1]["output"]["assets"][0]
    assert asset["transcript"] == [] and "Speech recognition failed (ValidationError)." in asset["warnings"]
    assert [s["text"] for s in got[2]["output"]["assets"][0]["transcript"]] == ["short talk"]


def test_last_of_a_key_is_kept_by_hash_aggregates(spark):
    rows = [("a", 5, 1, "downloading", 3), ("a", 5, 9, "finished", 96), ("a", 4, 99, "succeeded", 100), ("b", -7, 0, "downloading", 18)]
    shown = spark.createDataFrame(rows, "job string, ts long, event_id long, status string, percent long")
    last = progress.latest_progress(shown, "job", "ts", "event_id")
    assert sorted(map(tuple, last.collect())) == [("a", "finished", 96), ("b", "downloading", 18)]
    puts = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("l", 1, "w")], "cache_key string, ord long, output string")
    newest = cache.latest_per_key(puts, "ord")
    assert sorted(map(tuple, newest.collect())) == [("k", "z"), ("l", "w")]
    for df in (last, newest):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
