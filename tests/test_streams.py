"""Streams over several batches: restarts, late rows, repeats, state that is cleared."""

import random
from pathlib import Path

import pytest

from mediasift.streaming import jobs

CALLS = "key string, call_id long, ts long"
MS = 1000


class Feed:
    """A folder of files, one for each batch, and a job that drains it."""

    def __init__(self, spark, folder, schema, start):
        self.spark, self.source, self.schema, self.start = spark, str(folder / "in"), schema, start

    def send(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        return self.run()

    def run(self):
        self.start(self.spark.readStream.schema(self.schema).parquet(self.source)).awaitTermination()


def throttle(spark, tmp_path, interval=20 * MS, delay=100 * MS):
    out = str(tmp_path / "out")
    return Feed(spark, tmp_path, CALLS, lambda s: jobs.stream_throttle(s, interval, folder=out, delay=delay))


def admissions(spark, tmp_path):
    return {r["call_id"]: r["admit"] for r in spark.read.parquet(str(tmp_path / "out/admitted")).collect()}


def plain(calls, interval):
    last, out = {}, {}
    for ts, call, key in sorted(calls):
        last[key] = out[call] = max(ts, last[key] + interval) if key in last else ts
    return out


def test_throttle_equals_one_pass(spark, tmp_path):
    pick = random.Random(4)
    calls = sorted((pick.randint(0, 900) * MS, i, pick.choice("aab")) for i in range(150))
    feed = throttle(spark, tmp_path, delay=10_000 * MS)
    for part in range(3):
        some = [(k, c, t) for t, c, k in calls[part * 50 : part * 50 + 50]]
        pick.shuffle(some)
        feed.send(*some, (None, 1000 + part, 5), ("a", 2000 + part, None))
    want = plain(calls, 20 * MS) | {1000 + i: None for i in range(3)} | {2000 + i: None for i in range(3)}
    assert admissions(spark, tmp_path) == want


def test_throttle_batch_that_runs_again(spark, tmp_path):
    """A run that stopped before its batch was committed repeats it: same state, no second row."""
    feed = throttle(spark, tmp_path)
    feed.send(("a", 1, 1_000 * MS), ("a", 2, 1_001 * MS))
    feed.send(("a", 3, 1_002 * MS))
    last = max(Path(tmp_path / "out/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink()
    feed.run()
    feed.send(("a", 4, 1_003 * MS))
    rows = spark.read.parquet(str(tmp_path / "out/admitted"))
    assert rows.count() == 4
    assert admissions(spark, tmp_path) == {1: 1_000 * MS, 2: 1_020 * MS, 3: 1_040 * MS, 4: 1_060 * MS}


def test_throttle_late_calls_and_cleared_keys(spark, tmp_path):
    feed = throttle(spark, tmp_path)
    feed.send(("a", 1, 1_000 * MS), ("b", 2, 1_000 * MS))
    feed.send(("b", 3, 9_000 * MS))
    # Older than the newest less 100 ms: dropped, alone and beside a call in time.
    feed.send(("a", 4, 1_010 * MS))
    feed.send(("b", 5, 8_000 * MS), ("b", 6, 9_001 * MS), ("c", 7, 8_950 * MS))
    assert admissions(spark, tmp_path) == {1: 1_000 * MS, 2: 1_000 * MS, 3: 9_000 * MS, 6: 9_020 * MS, 7: 8_950 * MS}
    state = spark.read.format("statestore").option("stateVarName", "admission").load(str(tmp_path / "out/checkpoint"))
    assert {r["key"]["key"] for r in state.select("key").collect()} == {"b", "c"}


def test_throttle_delay_covers_the_interval(spark, tmp_path):
    with pytest.raises(ValueError, match="delay"):
        jobs.stream_throttle(spark.range(1), 100, folder=str(tmp_path), delay=10)


def test_throttle_in_a_session_with_another_state_store(spark, tmp_path):
    """A session that says nothing of its state store has one that cannot hold the state of the throttle."""
    name, plain_store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, plain_store)
    try:
        throttle(spark, tmp_path).send(("a", 1, 1_000 * MS), ("a", 2, 1_001 * MS))
        assert spark.conf.get(name) == plain_store
    finally:
        spark.conf.set(name, before)
    assert admissions(spark, tmp_path) == {1: 1_000 * MS, 2: 1_020 * MS}


def test_audit_has_one_row_a_request(spark, tmp_path):
    schema = "trace_id string, input_hash string, output_hash string, error_code string, at timestamp"
    start = lambda s: jobs.stream_audit(s, str(tmp_path / "table"), str(tmp_path / "checkpoint"), ts="at")
    feed = Feed(spark, tmp_path, schema, start)
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    feed.send(("a", "i", "o", None, at(1)), ("a", "i", "o", None, at(1, 5)), ("b", "i", "o", "failed", at(1)), (None, "i", "o", None, at(1)), (None, "i", "o", None, at(1)))
    feed.send(("a", "i", "o", None, at(1, 30)), ("c", "i", "o", None, at(8)))
    # Seven hours behind the newest: late, dropped.
    feed.send(("d", "i", "o", None, at(1)), ("c", "i", "o", None, at(8, 10)))
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    assert sorted((str(r["trace_id"]), r["event_type"]) for r in rows) == [
        ("None", "tool.succeeded"), ("None", "tool.succeeded"), ("a", "tool.succeeded"), ("b", "tool.failed"), ("c", "tool.succeeded"),
    ]


def outputs(spark, rows):
    from mediasift.suite.q_jobs import stored_analysis
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "id long, summary string")
    return table.select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), stored_analysis(F.lit("en"), F.col("summary")).alias("output"))


def cached(frame):
    return {r["cache_key"]: r["summary"] for r in frame.select("cache_key", "output.summary").collect()}


def test_cache_log_reads_no_more_with_its_history(spark, tmp_path):
    import hashlib

    from mediasift.sources.cache_log import BUCKETS, FAN, CacheLog

    log, want, read = CacheLog(spark, str(tmp_path / "cache")), {}, []
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    for batch in range(50):
        rows = [(batch * 3 + k, f"b{batch}") for k in range(3)] + [(7, f"again {batch}")]
        log.put(outputs(spark, rows), batch)
        want |= {key(i): s for i, s in rows}
        if batch % 5 == 4:
            keys = spark.createDataFrame([(key(batch * 3),), (key(7),), (key("none"),)], "cache_key string")
            found = log.entries(keys)
            read.append(len(found.inputFiles()))
            assert {k: v for k, v in cached(found).items() if k in (key(batch * 3), key(7))} == {key(batch * 3): f"b{batch}", key(7): f"again {batch}"}
            assert len(log.runs()) <= 3 * (FAN - 1) + 1
    assert cached(log.entries()) == want
    # Runs are as many as the digits of the batch number; without runs merged it would be one a batch.
    assert max(read) <= (3 * (FAN - 1) + 1) * BUCKETS
    nothing = spark.createDataFrame([(key("x"),), (None,), ("bad",)], "cache_key string")
    assert cached(log.entries(nothing.limit(0))) == {}
    # As it was before a batch, and a batch that runs again.
    old = {key(i): f"b{b}" for b in range(48) for i in range(b * 3, b * 3 + 3)} | {key(7): "again 47"}
    assert cached(log.entries(before=48)) in (old, {k: v for k, v in old.items()})
    log.put(outputs(spark, [(149, "repeated")]), 49)
    assert cached(log.entries())[key(149)] == "repeated" and cached(log.entries())[key(7)] == "again 48"


def test_cache_log_commits_whole_manifests(spark, tmp_path):
    from mediasift.sources.cache_log import CacheLog

    path = tmp_path / "cache"
    one, two = CacheLog(spark, str(path)), CacheLog(spark, str(path))
    one.put(outputs(spark, [(1, "a")]), 0)
    # A run that no manifest names is not read; a second writer of one version is refused.
    stray = two._write(outputs(spark, [(2, "b")]).selectExpr("cache_key", "to_json(output) AS output", "5L AS batch"), 0, 5, 5)
    assert stray.rows == 1 and len(cached(one.entries())) == 1
    assert CacheLog(spark, str(tmp_path / "none")).runs() == [] and CacheLog(spark, str(tmp_path / "none")).entries().count() == 0


def test_posts_of_any_length_reach_the_analysis(spark, tmp_path):
    """The SQL of these queries knows no longest post: one over 100,000 characters fails like any over 10,000."""
    from mediasift.suite.load import QUERIES

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["short one", "long " * 20_001, "long " * 20_001, "long " * 2_001]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    want = {0: (None, True), 1: ("analysis_failed", True), 2: ("analysis_failed", False), 3: ("analysis_failed", True)}
    for name in ("stream_analyze", "run_analysis"):
        found = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["request_id"]: (r["error_code"], r["computed"]) for r in found} == want, name


def test_cache_table_takes_the_first_of_a_text_in_two_languages(spark, tmp_path):
    from mediasift.suite.load import QUERIES

    rows = [(0, "a", "fr", "s"), (1, "a", "de", "s"), (2, "b", "es", "s2"), (3, "b", "en", "s3"), (4, "b", "en", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["summary"] for r in QUERIES["cache_table"](spark, str(tmp_path)).collect()) == ["fr", "s1"]
