"""Derived views over the given tables, as DataFrames; twins of ``sql_views``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import SEGMENT
from .sql_views import CJK_SUFFIX, KINDS, LONG_DECIMAL, VIDEO_SITES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df


def _pick(index: Column, values: list[str | None]) -> Column:
    chain = None
    for i, value in enumerate(values):
        chain = F.when(index == i, F.lit(value)) if chain is None else chain.when(index == i, F.lit(value))
    return chain


def _text(value: Column | str) -> Column:
    return F.col(value).cast("string") if isinstance(value, str) else value.cast("string")


def cat(*parts: Column | str) -> Column:
    """Concatenation; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def epoch_us(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone; independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def posts(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").toDF("request_id", "post_text")


def posts_cjk(spark, sf_dir) -> DataFrame:
    suffix = F.substring(F.lit(CJK_SUFFIX), F.lit(1), (1 + F.col("doc_id") % 12).cast("int"))
    return documents(spark, sf_dir, "doc_id", "text").select(
        F.col("doc_id").alias("request_id"), F.concat("text", F.lit(" "), suffix).alias("post_text")
    )


def artifact_array(doc_id: Column, source: Column, n_chars: Column, sha256: Column) -> Column:
    """A document's artifact manifest, built in its row."""

    def one(i: Column) -> Column:
        kind = (doc_id + i) % 8
        place = F.when((source == "src5") & (i == 1), "../outside/").otherwise("./")
        path = F.concat(
            F.lit("/media/"), place, source, F.lit("/"), doc_id.cast("string"), F.lit("-"),
            i.cast("string"), _pick(kind, [k[0] for k in KINDS]),
        )
        return F.struct(
            path.alias("path"), n_chars.alias("size_bytes"), sha256.alias("sha256"),
            _pick(kind, [k[1] for k in KINDS]).alias("media_type"),
        )

    return F.transform(F.sequence(F.lit(1), (1 + doc_id % 3).cast("int")), one)


def manifests(spark, sf_dir, *keep: str) -> DataFrame:
    """One row per document with its artifacts array."""
    columns = ["doc_id", "source", "n_chars", "text", *[k for k in keep if k not in ("source", "n_chars", "text")]]
    docs = documents(spark, sf_dir, *columns).withColumn("sha256", F.sha2("text", 256))
    return docs.select(
        F.col("doc_id").alias("request_id"), *keep,
        artifact_array(F.col("doc_id"), F.col("source"), F.col("n_chars"), F.col("sha256")).alias("artifacts"),
    )


def artifacts(spark, sf_dir, *keep: str) -> DataFrame:
    from ..operators.manifest import explode_artifacts

    return explode_artifacts(manifests(spark, sf_dir, *keep), *keep)


def files(spark, sf_dir) -> DataFrame:
    index = F.col("artifact_index")
    there = artifacts(spark, sf_dir, "source", "lang").filter(~((F.col("source") == "src3") & (index == 2)))
    digest = F.when((F.col("lang") == "es") & (index == 1), F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    return there.select(
        F.regexp_replace(F.regexp_replace("path", "/\\./", "/"), "^/media/\\.\\./", "/").alias("path"),
        (F.col("size_bytes") + F.when((F.col("lang") == "de") & (index == 3), 1).otherwise(0)).alias("length"),
        F.upper(digest).alias("sha256"),
        (~((F.col("source") == "src9") & (index == 2))).alias("is_regular"),
    )


def urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), "url")


def alt_urls(spark, sf_dir) -> DataFrame:
    page = F.col("page_id")
    tail = (
        F.when(page % 5 == 0, cat("/video/", page, "?from=feed"))
        .when(page % 7 == 0, cat("/jingxuan?modal_id=x", page))
        .otherwise(cat("/jingxuan?tab=1&modal_id=", page))
    )
    return table(spark, sf_dir, "pages").select(
        page.alias("request_id"), F.concat(F.lit("https://"), _pick(page % 3, list(VIDEO_SITES)), tail).alias("url")
    )


def share_text(spark, sf_dir) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        page.alias("request_id"),
        F.when(page % 4 == 0, cat("复制打开 http://xhslink.com/m/", page, ") ，复制本条信息"))
        .otherwise(cat("打开查看 ", F.col("url"), "，看视频！"))
        .alias("shared"),
    )


def play_pages(spark, sf_dir) -> DataFrame:
    page = F.col("page_id")
    address = F.when(page % 4 == 0, F.regexp_replace("url", "http://", "https://")).otherwise(
        cat("https://v26-web.douyinvod.com/a+b/", page, "?x=1")
    )
    for raw, code in ((":", "%3A"), ("/", "%2F"), ("\\?", "%3F")):
        address = F.regexp_replace(address, raw, code)
    mark = cat("%22awemeId%22%3A%22", page, "%22%22playAddr%22%3A%5B%7B%22src%22%3A%22", address, "%22")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat("html", F.when(page % 6 == 0, "").otherwise(mark)).alias("html")
    )


def dns(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    first = _pick(key % 9, ["8.8.", "10.1.", "127.0.", "198.18.", "100.64.", "203.0.", "192.168.", "172.15.", "224.0."])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lower(F.regexp_replace("s_name", "#", "-")), F.lit(".example.com")).alias("host"),
        F.when(key % 10 != 9, cat(first, key % 256, ".", F.col("s_nationkey"))).alias("ip"),
    )


def calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.concat_ws(":", _text("user_id"), "event_type").alias("key"),
        epoch_us().alias("ts"),
    )


def progress(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("job"), epoch_us().alias("ts"),
        F.when(kind == "error", "error").when(kind == "purchase", "finished").otherwise("downloading").alias("status"),
        F.col("value").alias("downloaded"),
        F.when(kind != "view", 500.0).alias("total"),
        F.when((kind == "view") & (F.col("user_id") % 2 == 0), 300.0).alias("estimate"),
    )


def record_parts(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    ident = F.when(key % 4 == 0, _text(key)).when(key % 4 == 1, F.lit('""')).otherwise(cat('"n', key, '"'))
    title = F.when(F.col("o_orderstatus") == "P", "7").otherwise(cat('"', F.col("o_orderpriority"), '"'))
    duration = (
        F.when(key % 5 == 0, '"60"').when(key % 5 == 1, "null").otherwise(cat(key % 7000, ".5"))
    )
    views = (
        F.when(key % 4 == 0, _text(key)).when(key % 4 == 1, '"10"').when(key % 4 == 2, "true")
        .otherwise(cat(F.col("o_custkey"), ".75"))
    )
    leaf = cat(
        '{"id":', ident, ',"title":', title, ',"extractor_key":"',
        F.when(F.col("o_orderstatus") == "O", "Example").otherwise(""), '","extractor":"generic"',
        ',"upload_date":"', F.date_format("o_orderdate", "yyyyMMdd"), F.when(key % 9 == 0, "x").otherwise(""), '"',
        ',"duration":', duration, ',"view_count":', views,
        ',"description":', F.when(key % 3 == 0, _text(key)).otherwise(cat('"About \\"', key, '\\"\\n"')),
        ',"uploader":"', F.col("o_custkey"), '","uploader_id":', F.when(key % 2 == 0, cat('"u', key, '"')).otherwise(_text(key)),
        ',"thumbnail":"', F.when(key % 7 == 0, "data").otherwise("http"), "://img.example.com/", key,
        '","like_count":', F.when(key % 3 == 0, "false").when(key % 3 == 1, _text(key)).otherwise(F.lit('"7"')),
        ',"repost_count":', F.when(key % 2 == 0, "null").otherwise(_text(key * 1_000_000_007)),
        ',"comment_count":', cat("-", key, ".5"), ',"score":', F.lit(LONG_DECIMAL), F.lpad(_text(key), 12, "0"), "1",
        ',"webpage_url":"', F.when(key % 6 == 0, "ftp").otherwise("https"), "://www.example.com/p/", key, '"}',
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", leaf.alias("leaf"))


def feeds(spark, sf_dir) -> DataFrame:
    """Nested feed pages: request_id, url_index, raw. A page covers a fixed range
    of order keys, so it holds at most 8,192 records however many a customer has."""
    parts = record_parts(spark, sf_dir)
    pages = parts.withColumn("url_index", F.floor(1 + F.col("o_orderkey") / 8192)).groupBy(
        "o_custkey", "url_index"
    ).agg(F.expr("listagg(leaf, ',') WITHIN GROUP (ORDER BY o_orderkey)").alias("leaves"))
    inner = cat('{"entries":[', F.col("leaves"), "]}")
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "BUILDING", inner)
        .when(segment == "MACHINERY", cat('{"entries":[', inner, ",5]}"))
        .when(segment == "FURNITURE", cat('{"entries":[{"entries":[]},{"entries":[', inner, "]}]}"))
        .when(segment == "HOUSEHOLD", cat('{"entries":[' * 8, inner, "]}" * 8))
        .otherwise('{"id":"solo","entries":"none"}')
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return pages.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("request_id"), "url_index", raw.alias("raw")
    )


def probe_logs(spark, sf_dir) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    log = (
        F.when(kind == "click", cat(
            '{"format":{"duration":"', F.col("value"), '"},"streams":[{"codec_type":"audio"},{"codec_type":"video","width":',
            user * 10, ',"height":"', user, '"}]}'))
        .when(kind == "view", '{"format":{},"streams":[]}')
        .when(kind == "error", "invalid data found")
        .otherwise(cat(
            "Input #0 Duration: 00:", F.lpad(_text(user % 60), 2, "0"), ":07.25, start\n",
            " Stream #0:0 Video: h264 (High), yuv420p, ", user + 100, "x", user + 200, ", 25 fps"))
    )
    return table(spark, sf_dir, "events").select("event_id", log.alias("log"))


def durations(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "signup", -F.col("value")).when(kind != "error", F.col("value")).alias("duration"),
    )


def model_replies(spark, sf_dir) -> DataFrame:
    doc, toxic, good = F.col("doc_id"), F.col("toxic") == 1, F.col("quality") == 1
    even = doc % 2 == 0
    body = cat(
        F.when(even, "```json\n").otherwise(""),
        '{"language":"', F.col("lang"), '","summary":"About ', F.col("source"), '","topics":["', F.col("source"), '","',
        F.upper("source"), '","Sale"],"entities":["', F.col("lang"), '"],"sentiment":"',
        F.when(toxic, "negative").otherwise("positive"), '",',
        F.when(good, '"commercial_intent":"promotion",').otherwise(""),
        '"safety_flags":', F.when(toxic, '["toxicity"," "]').otherwise("[]"),
        ',"confidence":', F.when(doc % 13 == 0, "1.5").when(good, "0.91").otherwise("0.4"),
        ',"evidence_refs":["post-text-1","ocr-1-1","ocr-9-9"],"extra":1}',
        F.when(even, "\n```").otherwise(""),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        doc.alias("request_id"),
        F.when(doc % 11 == 0, '{"language": "en", ').otherwise(body).alias("reply"),
        F.when(F.col("source") == "src14", "TimeoutError").alias("error"),
    )


def turns(spark, sf_dir) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        (1 + F.floor(turn / 4)).cast("int").alias("artifact_index"),
        turn.alias("seg_no"),
        (turn * 10.0).alias("start_seconds"),
        (turn * 10.0 + 5.0).alias("end_seconds"),
        "text",
    )


def transcripts(spark, sf_dir) -> DataFrame:
    """request_id, artifact_index, segments: four turns form one recording."""
    shaped = turns(spark, sf_dir).groupBy("request_id", "artifact_index").agg(
        F.sort_array(
            F.collect_list(F.struct("seg_no", F.struct(*SEGMENT.fieldNames()).alias("segment")))
        ).alias("s")
    )
    return shaped.select(
        "request_id", "artifact_index", F.transform("s", lambda x: x["segment"]).alias("segments")
    )


def messages(spark, sf_dir) -> DataFrame:
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    # A message is as long as its user's number is large, and files may hold users in order:
    # the narrow rows are dealt by event, so that all tasks make about as much text.
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "event_id").select(
        "event_id",
        F.when(kind == "error", cat("ERROR: [twitter] ", event, ": No video could be found in this tweet"))
        .when(kind == "click", cat("Fresh cookies (not necessarily logged in) are needed ", user))
        .when(kind == "view", cat("Unsupported URL: https://host", user, ".example.com/a?b=", event, " stop"))
        .when(kind == "signup", cat(
            "No video formats found! see http://a.b/", user, " and https://c.d/",
            F.repeat(F.lit("x"), (user * 5).cast("int"))))
        .otherwise("timed out")
        .alias("message"),
    )
