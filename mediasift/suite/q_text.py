"""Queries: keywords, evidence, tags, samples, schedules, reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import media, replies, text
from ..functions.core import empty_array, unique_texts
from ..operators import cache, evidence as ev, keywords, plugins, progress, sampling, tags, throttle
from ..plans.understand import understand_posts
from . import views as v
from .registry import query
from .sql_views import collapse, compact, language, sentence, strip, tokens

DAY_US = 86_400_000_000


# --- keywords ---------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


def counted(source: str, column: str) -> str:
    return f"""SELECT request_id, word, count(*) AS n, min(p) AS first_pos
      FROM (SELECT request_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS p
            FROM (SELECT request_id, {tokens(column)} AS toks FROM {source}))
      WHERE word NOT IN ({_STOP}) GROUP BY ALL"""


def ranked(source: str, column: str) -> str:
    return f"""SELECT request_id, word, n, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, first_pos) AS rank
      FROM ({counted(source, column)})"""


@query("keyword_counts", counted("posts_cjk", "post_text"))
def _(spark, d):
    return keywords.keyword_count_rows(v.posts_cjk(spark, d), "post_text")


@query("keywords_topk", f"SELECT * FROM ({ranked('posts_cjk', 'post_text')}) WHERE rank <= 8")
def _(spark, d):
    return keywords.keyword_rows(v.posts_cjk(spark, d), "post_text")


@query(
    "keywords_topk_parts",
    f"""WITH toks AS (SELECT conv_id AS request_id, turn AS part, {tokens('text')} AS t FROM conversations),
      words AS (SELECT request_id, part, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM toks),
      sums AS (SELECT request_id, word, count(*) AS n, min((regexp_matches(word, '[{fixed.CJK}]')::INT * 1000000 + part) * 1000000 + p) AS f
               FROM words WHERE word NOT IN ({_STOP}) GROUP BY ALL)
    SELECT request_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, f) AS rank FROM sums) WHERE rank <= 8""",
)
def _(spark, d):
    parts = v.table(spark, d, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("part_no"), "text"
    )
    return keywords.top_words_of_parts(parts)


@query(
    "stopword_anti_join",
    f"""SELECT request_id, word, count(*) AS n FROM (SELECT request_id, unnest({tokens('post_text')}) AS word FROM posts_cjk)
        WHERE word NOT IN ({_STOP}) GROUP BY ALL""",
)
def _(spark, d):
    words = v.posts_cjk(spark, d).select("request_id", F.explode(text.union_tokens("post_text")).alias("word"))
    return keywords.without_stop_words(words).groupBy("request_id", "word").agg(F.count("*").alias("n"))


TOPICS_SQL = "SELECT request_id, string_agg(word, '|' ORDER BY rank) AS topics FROM ({}) WHERE rank <= 8 GROUP BY request_id"


@query(
    "understand_posts",
    f"""SELECT p.request_id, {language('n')} AS language, CASE WHEN n = '' THEN '{''.join(fixed.NO_TEXT_SUMMARY)}' ELSE {compact('n')} END AS summary,
        coalesce(topics, '') AS topics, CASE WHEN n = '' THEN '' ELSE {sentence('n')} END AS claims, 'neutral' AS sentiment,
        CASE WHEN n = '' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS confidence, '' AS entities, NULL::VARCHAR AS image_summary, NULL::VARCHAR AS video_summary,
        NULL::VARCHAR AS transcript_summary, NULL::VARCHAR AS commercial_intent, '' AS safety_flags, CASE WHEN n = '' THEN '' ELSE 'post-text-1' END AS evidence_refs
      FROM (SELECT request_id, {collapse('post_text')} AS n FROM posts) p
      LEFT JOIN ({TOPICS_SQL.format(ranked('posts', 'post_text'))}) t ON t.request_id = p.request_id""",
)
def _(spark, d):
    return understand_posts(v.posts(spark, d)).withColumns(
        {c: F.array_join(c, "|") for c in ("topics", "entities", "claims", "safety_flags", "evidence_refs")}
    )


# --- evidence ---------------------------------------------------------------
UNIQUE_LINES_SQL = f"""SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
    SELECT doc_id, line, min(pos) AS pos FROM (
      SELECT doc_id, {collapse('raw')} AS line, pos FROM (
        SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
    WHERE line <> '' GROUP BY ALL)"""


def lines(column: str = "text"):
    return F.split(column, "\n")


@query("unique_texts", f"SELECT doc_id, line, n FROM ({UNIQUE_LINES_SQL})")
def _(spark, d):
    return (
        v.documents(spark, d, "doc_id", "text")
        .select("doc_id", F.posexplode(unique_texts(lines())).alias("i", "line"))
        .select("doc_id", "line", (F.col("i") + 1).alias("n"))
    )


@query(
    "number_evidence",
    f"""SELECT request_id, 'ocr-1-' || n AS evidence_id, line AS text, CASE WHEN lang = 'en' THEN 0.8 ELSE 0.85 END::DOUBLE AS confidence,
          NULL::DOUBLE AS timestamp_seconds FROM (SELECT u.doc_id AS request_id, line, n, lang FROM ({UNIQUE_LINES_SQL}) u JOIN documents d ON d.doc_id = u.doc_id)
        UNION ALL SELECT request_id, 'transcript-' || artifact_index || '-' || row_number() OVER (PARTITION BY request_id, artifact_index ORDER BY seg_no),
          {strip('text')}, 0.85::DOUBLE, start_seconds::DOUBLE FROM turns WHERE {strip('text')} <> ''""",
)
def _(spark, d):
    docs = v.documents(spark, d, "doc_id", "text", "lang")
    modality = F.when(F.col("lang") == "en", "video").otherwise("image")
    nothing = F.lit(None).cast("string")
    seen = ev.ocr_evidence(F.lit(1), nothing, unique_texts(lines()), modality)
    spoken = ev.transcript_evidence(F.col("artifact_index"), nothing, ev.clean_segments(F.col("segments")))
    both = docs.select(F.col("doc_id").alias("request_id"), F.explode(seen).alias("e")).unionByName(
        v.transcripts(spark, d).select("request_id", F.explode(spoken).alias("e"))
    )
    return both.select("request_id", "e.evidence_id", "e.text", "e.confidence", "e.timestamp_seconds")


@query(
    "union_evidence",
    f"""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY part, n) AS ord, evidence_id, kind, text FROM (
          SELECT doc_id AS request_id, 0 AS part, 1 AS n, 'post-text-1' AS evidence_id, 'post_text' AS kind, text FROM documents WHERE text <> ''
          UNION ALL SELECT doc_id, 1, n, 'ocr-1-' || n, 'ocr', line FROM ({UNIQUE_LINES_SQL})
          UNION ALL SELECT doc_id, 2, 1, 'visual-model-1', 'visual', '{fixed.VISUAL_EVIDENCE}' FROM documents WHERE lang = 'en')""",
)
def _(spark, d):
    docs = v.documents(spark, d, "doc_id", "text", "lang")
    seen = ev.ocr_evidence(F.lit(1), F.lit(None).cast("string"), unique_texts(lines()), F.lit("image"))
    visual = F.when(F.col("lang") == "en", ev.visual_evidence(F.lit(0.9)))
    rows = ev.union_evidence(F.col("text"), F.array(seen), visual)
    return docs.select(F.col("doc_id").alias("request_id"), F.posexplode(rows).alias("i", "e")).select(
        "request_id", (F.col("i") + 1).alias("ord"), "e.evidence_id", "e.kind", "e.text"
    )


@query(
    "ordered_text",
    f"""SELECT t.request_id, transcript, concat_ws(' ', nullif(lang, ''), nullif(transcript, ''), nullif(ocr, '')) AS combined
      FROM (SELECT request_id, string_agg({strip('text')}, ' ' ORDER BY seg_no) AS transcript FROM turns WHERE {strip('text')} <> '' GROUP BY ALL) t
      JOIN documents d ON d.doc_id = t.request_id
      LEFT JOIN (SELECT doc_id, string_agg(line, ' ' ORDER BY n) AS ocr FROM ({UNIQUE_LINES_SQL}) GROUP BY ALL) o ON o.doc_id = t.request_id""",
)
def _(spark, d):
    recordings = v.transcripts(spark, d)
    spoken = ev.joined(F.transform(ev.clean_segments(F.col("segments")), lambda s: s["text"]))
    per_request = recordings.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("artifact_index", spoken.alias("t")))).alias("r")
    )
    docs = v.documents(spark, d, "doc_id", "text", "lang").withColumnRenamed("doc_id", "request_id")
    transcript = ev.joined(F.transform("r", lambda x: x["t"]))
    seen = ev.joined(unique_texts(lines()))
    return per_request.join(docs, "request_id").select(
        "request_id", transcript.alias("transcript"),
        ev.ordered_text(F.col("lang"), transcript, seen).alias("combined"),
    )


ASSETS_SQL = """SELECT m.request_id, m.artifact_index, modality, media_type, CASE WHEN d.lang = 'de' THEN 0 ELSE 100 + d.n_chars % 900 END AS width,
    200 + m.artifact_index AS height, CASE WHEN source = 'src15' THEN NULL WHEN source = 'src16' THEN 0.0 ELSE d.n_chars / 4.0 END AS duration,
    5 + m.artifact_index AS frames FROM media m JOIN documents d ON d.doc_id = m.request_id"""


@query(
    "build_context",
    f"""SELECT a.request_id, trusted, left(untrusted, 120000) AS untrusted FROM (
        SELECT request_id, string_agg('asset-' || artifact_index || ': modality=' || modality || ', media_type=' || media_type || ', size='
          || coalesce(nullif(width, 0)::VARCHAR, '?') || 'x' || coalesce(nullif(height, 0)::VARCHAR, '?') || ', duration='
          || coalesce(nullif(duration, 0)::VARCHAR, '?') || 's, sampled_frames=' || frames, chr(10) ORDER BY artifact_index) AS trusted
        FROM ({ASSETS_SQL}) GROUP BY request_id) a
      LEFT JOIN (SELECT doc_id, string_agg('[ocr-1-' || n || '|ocr] ' || line, chr(10) ORDER BY n) AS untrusted FROM ({UNIQUE_LINES_SQL}) GROUP BY doc_id) u
        ON u.doc_id = a.request_id""",
)
def _(spark, d):
    rows = v.manifests(spark, d, "source", "n_chars", "text", "lang")
    source, n = F.col("source"), F.col("n_chars")

    def asset(a, i):
        kind = media.detect_media(a["path"], a["media_type"])
        return F.struct(
            kind["modality"].alias("modality"), kind["media_type"].alias("media_type"),
            F.when(F.col("lang") == "de", 0).otherwise(100 + n % 900).alias("width"),
            (201 + i).alias("height"),
            F.when(source == "src16", 0.0).when(source != "src15", n / 4.0).alias("duration_seconds"),
            (6 + i).alias("sampled_frame_count"),
        )

    seen = ev.ocr_evidence(F.lit(1), F.lit(None).cast("string"), unique_texts(lines()), F.lit("image"))
    return rows.select(
        "request_id", ev.trusted_context(F.transform("artifacts", asset)).alias("trusted"),
        ev.untrusted_context(seen).alias("untrusted"),
    ).withColumn("untrusted", F.when(F.col("untrusted") != "", F.col("untrusted")))


@query(
    "request_modalities",
    """SELECT request_id, coalesce(string_agg(modality, '|' ORDER BY first), '') AS first_seen, coalesce(string_agg(modality, '|' ORDER BY modality), '') AS sorted,
        count(modality) = 0 AS unsupported FROM (SELECT request_id, CASE WHEN modality <> 'unknown' THEN modality END AS modality, min(artifact_index) AS first
        FROM media GROUP BY ALL) GROUP BY request_id""",
)
def _(spark, d):
    assets = F.transform("artifacts", lambda a: media.detect_media(a["path"], a["media_type"]))
    rows = v.manifests(spark, d).select("request_id", ev.modalities(assets).alias("m"))
    return rows.select(
        "request_id", F.array_join("m", "|").alias("first_seen"),
        F.array_join(F.sort_array("m"), "|").alias("sorted"), (F.size("m") == 0).alias("unsupported"),
    )


@query(
    "first_n_refs",
    f"""SELECT doc_id, string_agg('ocr-1-' || n, '|' ORDER BY n) AS refs FROM ({UNIQUE_LINES_SQL}) WHERE n <= 20 GROUP BY doc_id""",
)
def _(spark, d):
    seen = ev.ocr_evidence(F.lit(1), F.lit(None).cast("string"), unique_texts(lines()), F.lit("image"))
    rows = v.documents(spark, d, "doc_id", "text").select("doc_id", ev.first_refs(seen).alias("r"))
    return rows.filter(F.size("r") > 0).select("doc_id", F.array_join("r", "|").alias("refs"))


@query(
    "merge_warnings",
    f"""SELECT doc_id, string_agg(w, '|' ORDER BY first) AS warnings FROM (SELECT doc_id, w, min(pos) AS first FROM (
          SELECT doc_id, {collapse('raw')} AS w, pos FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (
            SELECT doc_id, [lang || '  missing', source, lang || ' missing', source || ' ', '  ', lang] AS l FROM documents))) WHERE w <> '' GROUP BY ALL) GROUP BY doc_id""",
)
def _(spark, d):
    lang, source = F.col("lang"), F.col("source")
    request = F.array(v.cat(lang, "  missing"), source)
    assets = F.array(F.array(v.cat(lang, " missing"), v.cat(source, " ")), F.array(F.lit("  "), lang))
    return v.documents(spark, d, "doc_id", "lang", "source").select(
        "doc_id", F.array_join(ev.merge_warnings(request, assets), "|").alias("warnings")
    )


# --- tags -------------------------------------------------------------------
_TAGS_SQL = """SELECT request_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS ord,
    unnest(['topic', 'topic', 'topic', 'entity', 'format', 'format', 'sentiment', 'commercial', 'safety', 'safety']) AS ns,
    unnest([j->>'$.topics[0]', j->>'$.topics[1]', j->>'$.topics[2]', j->>'$.entities[0]', 'image', 'video', j->>'$.sentiment',
      j->>'$.commercial_intent', j->>'$.safety_flags[0]', j->>'$.safety_flags[1]']) AS label,
    CAST(j->>'$.confidence' AS DOUBLE) AS confidence FROM ({})"""


def _parsed_sql() -> str:
    from .q_scalars import PARSED_SQL

    return f"SELECT * FROM ({PARSED_SQL}) WHERE j IS NOT NULL AND CAST(j->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1"


def _answers(spark, d):
    parsed = v.model_replies(spark, d).select("request_id", replies.parse_semantic_payload("reply").alias("s"))
    return parsed.filter(F.col("s").isNotNull())


def _all_tags():
    return tags.union_tags(F.col("s"), F.array(F.lit("video"), F.lit("image")), F.array(F.lit("post-text-1")))


@query(
    "union_tags",
    f"""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS n, ns AS namespace, label,
        CASE WHEN ns = 'format' THEN 1.0 ELSE confidence END AS confidence, CASE WHEN ns = 'format' THEN 0 ELSE 1 END AS n_refs
        FROM ({_TAGS_SQL.format(_parsed_sql())}) WHERE label IS NOT NULL""",
)
def _(spark, d):
    rows = _answers(spark, d).select("request_id", F.posexplode(_all_tags()).alias("i", "t"))
    return rows.select(
        "request_id", (F.col("i") + 1).alias("n"), "t.namespace", "t.label", "t.confidence",
        F.size("t.evidence_refs").alias("n_refs"),
    )


@query(
    "dedupe_tags",
    f"""SELECT request_id, arg_min(label, ord) AS label, ns AS namespace, min(ord) AS place FROM ({_TAGS_SQL.format(_parsed_sql())})
        WHERE trim(label) <> '' GROUP BY request_id, ns, lower(label)""",
)
def _(spark, d):
    both = _answers(spark, d).withColumn("a", _all_tags())
    kept = both.select("request_id", "s", F.explode(tags.dedupe_tags(F.col("a"))).alias("t"))
    # Place in the full ten-slot order, so that order can be compared.
    base = {"topic": 1, "entity": 4, "format": 5, "sentiment": 7, "commercial": 8, "safety": 9}
    label = F.col("t.label")
    place = (
        F.when(F.col("t.namespace") == "topic", F.array_position("s.topics", label))
        .when(F.col("t.namespace") == "format", F.when(label == "image", 5).otherwise(6))
    )
    for ns in ("entity", "sentiment", "commercial", "safety"):
        place = place.when(F.col("t.namespace") == ns, base[ns])
    return kept.select("request_id", "t.label", "t.namespace", place.cast("bigint").alias("place"))


# --- model results ----------------------------------------------------------
@query(
    "merge_semantic",
    f"""SELECT p.doc_id AS request_id, CASE WHEN ok THEN j->>'$.language' ELSE {language('n')} END AS language,
        CASE WHEN ok THEN j->>'$.sentiment' ELSE 'neutral' END AS sentiment,
        CASE WHEN r.request_id IS NULL THEN NULL WHEN ok THEN NULL WHEN r.error IS NOT NULL THEN 'Semantic model failed; deterministic fallback used (TimeoutError).'
          ELSE 'Semantic model failed; deterministic fallback used (ValidationError).' END AS warning
      FROM (SELECT doc_id, {collapse('text')} AS n FROM documents) p LEFT JOIN model_replies r ON r.request_id = p.doc_id
      LEFT JOIN (SELECT a.request_id, j, r.error IS NULL AS ok FROM ({_parsed_sql()}) a JOIN model_replies r ON r.request_id = a.request_id) g ON g.request_id = p.doc_id""",
)
def _(spark, d):
    posts = understand_posts(v.posts(spark, d)).select("request_id", "language", "sentiment")
    answers = v.model_replies(spark, d).withColumn(
        "s", F.when(F.col("error").isNull(), replies.parse_semantic_payload("reply"))
    ).select("request_id", "s", F.when(F.col("s").isNull(), F.coalesce("error", F.lit("ValidationError"))).alias("failed"))
    warning = F.format_string(fixed.WARN_MODEL_FAILED.replace("{}", "%s"), F.col("failed"))
    return posts.join(answers, "request_id", "left").select(
        "request_id", F.coalesce("s.language", "language").alias("language"),
        F.coalesce("s.sentiment", "sentiment").alias("sentiment"),
        F.when(F.col("failed").isNotNull(), warning).alias("warning"),
    )


@query(
    "valid_evidence_refs",
    f"""SELECT request_id, 'post-text-1' || CASE WHEN n >= 1 THEN '|ocr-1-1' ELSE '' END || CASE WHEN lang = 'en' THEN '|visual-model-1' ELSE '' END AS refs
      FROM (SELECT a.request_id, lang, (SELECT count(*) FROM ({UNIQUE_LINES_SQL}) u WHERE u.doc_id = a.request_id) AS n FROM ({_parsed_sql()}) a
        JOIN documents d ON d.doc_id = a.request_id)""",
)
def _(spark, d):
    docs = v.documents(spark, d, "doc_id", "text", "lang").withColumnRenamed("doc_id", "request_id")
    seen = ev.ocr_evidence(F.lit(1), F.lit(None).cast("string"), unique_texts(lines()), F.lit("image"))
    known = F.concat(F.array(F.lit("post-text-1")), F.transform(seen, lambda e: e["evidence_id"]))
    extra = F.when(F.col("lang") == "en", F.array(F.lit("visual-model-1"))).otherwise(empty_array("string"))
    refs = F.concat(replies.evidence_refs(F.col("s.evidence_refs"), known), extra)
    return _answers(spark, d).join(docs, "request_id").select("request_id", F.array_join(refs, "|").alias("refs"))


# --- samples and schedules --------------------------------------------------
SAMPLE_SQL = """SELECT user_id, i AS sample_no, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p,
    count(*) OVER (PARTITION BY user_id) AS n FROM events) JOIN (SELECT unnest(generate_series(0, {m} - 1)) AS i) g
    ON (n > {m} AND p = round_even(i * (n - 1) / {m1}.0, 0)) OR (n <= {m} AND p = i)"""


@query("evenly_sample", SAMPLE_SQL.format(m=24, m1=23))
def _(spark, d):
    events = v.table(spark, d, "events").select("event_id", "user_id", v.epoch_us().alias("ts"))
    return sampling.evenly_sample_rows(events, ["user_id"], ["ts", "event_id"], 24).select(
        "user_id", "sample_no", "event_id"
    )


@query(
    "limit_images",
    """SELECT doc_id, array_to_string(CASE WHEN n <= 16 THEN list_transform(range(n), lambda i: i) ELSE
        list_transform(range(16), lambda i: CAST(round_even(i * (n - 1) / 15.0, 0) AS BIGINT)) END, ',') AS picked
      FROM (SELECT doc_id, 1 + n_chars % 60 AS n FROM documents)""",
)
def _(spark, d):
    images = F.sequence(F.lit(0).cast("bigint"), F.col("n_chars") % 60)
    return v.documents(spark, d, "doc_id", "n_chars").select(
        "doc_id", F.array_join(sampling.limit_images(images), ",").alias("picked")
    )


@query(
    "uniform_timestamps",
    """SELECT event_id, i AS n, CASE WHEN duration > 0 THEN duration * (i + 0.5::DOUBLE) / k ELSE 0.0::DOUBLE END AS timestamp_seconds
      FROM (SELECT event_id, duration, unnest(range(k)) AS i, k FROM (SELECT *, CASE WHEN duration > 0 THEN
        least(24, greatest(1, CAST(ceil(duration / 10.0::DOUBLE) AS BIGINT))) ELSE 1 END AS k FROM durations))""",
)
def _(spark, d):
    return sampling.uniform_timestamp_rows(v.durations(spark, d), "duration", 24, "event_id")


THROTTLE_SQL = """SELECT call_id, key, i * {d} + max(ts - i * {d}) OVER (PARTITION BY key ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS admit
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, call_id) AS i FROM calls)"""


@query("throttle_schedule", THROTTLE_SQL.format(d=DAY_US))
def _(spark, d):
    return throttle.throttle_schedule(v.calls(spark, d), DAY_US).select("call_id", "key", "admit")


@query(
    "latest_progress",
    """SELECT job, arg_max(status, (ts, event_id)) AS status, CAST(arg_max(percent, (ts, event_id)) AS BIGINT) AS percent FROM (
        SELECT *, CASE status WHEN 'finished' THEN 96 WHEN 'downloading' THEN greatest(2, least(92, CASE WHEN downloaded <> 0
          AND coalesce(total, estimate) IS NOT NULL THEN CAST(trunc(downloaded / coalesce(total, estimate) * 92) AS BIGINT) ELSE 18 END)) END AS percent
        FROM progress) WHERE percent IS NOT NULL GROUP BY job""",
)
def _(spark, d):
    shown = progress.progress_status(v.progress(spark, d))
    return progress.latest_progress(shown, "job", "ts", "event_id")


# --- reuse ------------------------------------------------------------------
def keyed_requests(spark, d):
    return v.documents(spark, d, "doc_id", "text", "source").select(
        F.col("doc_id").alias("request_id"), F.sha2("text", 256).alias("cache_key"),
        (F.col("source") == "src6").alias("force_reanalyze"),
    )


@query(
    "cache_lookup",
    """SELECT d.doc_id AS request_id, CASE WHEN d.source <> 'src6' THEN c.v END AS cached, d.source <> 'src6' AND c.v IS NOT NULL AS cache_hit
      FROM documents d LEFT JOIN (SELECT text, min(lang) AS v FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY text) c ON c.text = d.text""",
)
def _(spark, d):
    stored = (
        v.documents(spark, d, "text", "source", "lang")
        .filter(F.col("source").isin("src1", "src2", "src3"))
        .groupBy(F.sha2("text", 256).alias("cache_key"))
        .agg(F.min("lang").alias("output"))
    )
    looked = cache.cache_lookup(keyed_requests(spark, d), stored)
    return looked.select("request_id", "cached", F.col("cached").isNotNull().alias("cache_hit"))


@query(
    "cache_first_and_last",
    """SELECT doc_id AS request_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS computes,
        last_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_writer FROM documents""",
)
def _(spark, d):
    requests = keyed_requests(spark, d).drop("force_reanalyze")
    last = cache.latest_per_key(requests.withColumn("ord", F.col("request_id")), "ord").select(
        "cache_key", F.col("request_id").alias("last_writer")
    )
    return cache.mark_first(requests).join(last, "cache_key").select("request_id", "computes", "last_writer")


# --- hashes and recognizers -------------------------------------------------
_HEX = "array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', 1 + 8*b[4*i+1] + 4*b[4*i+2] + 2*b[4*i+3] + b[4*i+4], 1)), '')"


@query(
    "average_hash",
    f"""SELECT vec_id, 'ahash:' || {_HEX} AS hash FROM (SELECT vec_id, list_transform(c, lambda x: CASE WHEN x >= m THEN 1 ELSE 0 END) AS b FROM (
        SELECT *, list_reduce(c, lambda a, x: a + x) / 64 AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings)))""",
)
def _(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", media.average_hash("embedding").alias("hash"))


_GRAY = "CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (x::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE))) AS INT)"


@query(
    "image_ahash",
    f"""SELECT vec_id, 'ahash:' || {_HEX} AS hash FROM (SELECT vec_id, list_transform(c, lambda x: CASE WHEN x * 64 >= m THEN 1 ELSE 0 END) AS b FROM (
        SELECT *, list_sum(c) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: {_GRAY}) AS c FROM embeddings)))""",
)
def _(spark, d):
    gray = F.transform(
        "embedding",
        lambda x: F.floor(
            F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 1.0) * 127.5))
        ).cast("int"),
    )
    # Each cell becomes a 2x2 patch of equal pixels, whose area mean is the cell.
    rows = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda r: F.transform(
                F.sequence(F.lit(0), F.lit(15)),
                lambda c: F.lpad(F.hex(F.get(F.col("g"), (F.floor(r / 2) * 8 + F.floor(c / 2)).cast("int"))), 2, "0"),
            ),
        )
    )
    image = F.struct(
        F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(rows, "")).alias("data"),
    )
    images = v.table(spark, d, "embeddings").select("vec_id", gray.alias("g")).select("vec_id", image.alias("image"))
    return plugins.image_ahash(images, "image", "hash").drop("image")


@query("collect_ocr_text", f"SELECT doc_id, string_agg(line, '|' ORDER BY n) AS texts FROM ({UNIQUE_LINES_SQL}) GROUP BY doc_id")
def _(spark, d):
    found = F.filter(lines(), lambda x: F.length(x) > 0)
    # Old shape: [[box, [text, score]], ...]; arrays of mixed type are put together as text.
    def old_line(x):
        doc = F.to_json(F.struct(x.alias("t")))
        return F.concat(F.lit("[[[0,0],[1,1]],["), F.substr(doc, F.lit(6), F.length(doc) - 6), F.lit(",0.9]]"))

    old = F.concat(F.lit("[["), F.array_join(F.transform(found, old_line), ","), F.lit("]]"))
    new = F.to_json(F.struct(F.struct(found.alias("rec_texts")).alias("res")))
    deep = F.to_json(F.struct(F.transform(found, lambda x: F.struct(F.struct(x.alias("text")).alias("block"))).alias("pages")))
    shaped = F.when(F.col("lang") == "en", old).when(F.col("lang") == "fr", new).otherwise(deep)
    docs = v.documents(spark, d, "doc_id", "text", "lang").select("doc_id", shaped.alias("result"))
    read = plugins.ocr_texts(docs, "result", "l")
    return read.select("doc_id", F.array_join(unique_texts(F.col("l")), "|").alias("texts")).filter(
        F.col("texts") != ""
    )


# --- plug-ins with stand-in engines -----------------------------------------
def _line_reader():
    return lambda content: {"rec_texts": content.decode("utf-8").split("\n")}


def _line_recognizer():
    return lambda content, hint: [
        (float(10 * i) - 5.0, 10.0 * i + 5.0, line)
        for i, line in enumerate(content.decode("utf-8").split("\n"))
    ]


def _echo_model():
    import json

    def answer(request: str) -> str | None:
        asked = json.loads(request)
        if asked["source"] == "src1":
            raise TimeoutError
        if asked["source"] == "src2":
            return None
        return json.dumps({"language": asked["lang"], "confidence": 0.7, "topics": [asked["source"]]})

    return answer


@query("ocr_udf", f"SELECT doc_id, string_agg(line, '|' ORDER BY n) AS texts FROM ({UNIQUE_LINES_SQL}) GROUP BY doc_id")
def _(spark, d):
    images = v.documents(spark, d, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("content"))
    got = plugins.ocr_udf(images, _line_reader, "doc_id")
    return got.select("doc_id", F.array_join(unique_texts(F.col("ocr_lines")), "|").alias("texts")).filter(
        F.col("texts") != ""
    )


@query(
    "asr_udf",
    f"""SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n, string_agg(t, '|' ORDER BY i) AS texts, min(greatest(0.0::DOUBLE, 10.0::DOUBLE * i - 5)) AS first_start
      FROM (SELECT conv_id, turn, {strip('raw')} AS t, i FROM (SELECT conv_id, turn, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))) WHERE t <> '' GROUP BY ALL""",
)
def _(spark, d):
    audio = v.table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("language_hint")
    )
    got = plugins.asr_udf(audio, _line_recognizer, "conv_id", "turn").select(
        "conv_id", "turn", ev.clean_segments(F.col("segments")).alias("s")
    )
    return got.filter(F.size("s") > 0).select(
        "conv_id", "turn", F.size("s").cast("bigint").alias("n"),
        F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"),
        F.array_min(F.transform("s", lambda x: x["start_seconds"])).alias("first_start"),
    )


@query(
    "semantic_udf",
    """SELECT doc_id, CASE WHEN source NOT IN ('src1', 'src2') THEN lang END AS language, CASE WHEN source = 'src1' THEN 'TimeoutError' END AS error,
        CASE WHEN source NOT IN ('src1', 'src2') THEN source END AS topics FROM documents""",
)
def _(spark, d):
    docs = v.documents(spark, d, "doc_id", "lang", "source")
    asked = docs.select("doc_id", F.to_json(F.struct("lang", "source")).alias("model_request"))
    got = plugins.semantic_udf(asked, _echo_model, "doc_id").withColumn(
        "s", replies.parse_semantic_payload("reply")
    )
    return got.select("doc_id", "s.language", "error", F.array_join("s.topics", "|").alias("topics"))


@query(
    "model_request_rows",
    f"""SELECT doc_id, sha256('{fixed.USER_PROMPT_HEAD}' || 'LANGUAGE_HINT: ' || CASE WHEN lang = 'fr' THEN 'fr' ELSE 'auto' END || chr(10) || 'TRUSTED_MEDIA_CONTEXT:' || chr(10)
        || source || chr(10) || chr(10) || 'UNTRUSTED_CONTENT:' || chr(10) || text || chr(10) || chr(10) || '{fixed.USER_PROMPT_TAIL}') AS prompt_hash,
        0.1::DOUBLE AS temperature, 2 AS n_messages, 1 + least(16, n_chars % 20) AS n_parts,
        CASE WHEN n_chars % 20 > 0 THEN 'data:image/png;base64,' || to_base64(encode(lang)) END AS first_image FROM documents""",
)
def _(spark, d):
    docs = v.documents(spark, d, "doc_id", "text", "lang", "source", "n_chars")
    prompt = plugins.user_prompt(F.when(F.col("lang") == "fr", "fr"), F.col("source"), F.col("text"))
    images = F.transform(
        F.array_repeat(F.col("lang"), (F.col("n_chars") % 20).cast("int")),
        lambda x, i: F.struct(v.cat("p", i, ".png").alias("path"), x.cast("binary").alias("content")),
    )
    body = F.try_parse_json(plugins.model_request(prompt, images))
    get = lambda path, kind: F.try_variant_get("b", path, kind)
    return docs.select("doc_id", body.alias("b")).select(
        "doc_id",
        F.sha2(get("$.messages[1].content[0].text", "string"), 256).alias("prompt_hash"),
        get("$.temperature", "double").alias("temperature"),
        F.size(get("$.messages", "array<variant>")).alias("n_messages"),
        F.size(get("$.messages[1].content", "array<variant>")).cast("bigint").alias("n_parts"),
        get("$.messages[1].content[1].image_url.url", "string").alias("first_image"),
    )
