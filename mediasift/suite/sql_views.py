"""Derived views over the given tables, as SQL. ``views`` has the Spark twins."""

from __future__ import annotations

from ..fixed import CJK, PLATFORMS, WS

# Digits of a decimal that no double holds.
LONG_DECIMAL = "0.123456789012"
CJK_SUFFIX = "新品发布会上海舞台产品海报"
VIDEO_SITES = ("www.douyin.com", "douyin.com", "www.bilibili.com")

# (extension, declared media type) by (doc_id + artifact_index) % 8
KINDS = (
    (".jpg", "image/jpeg"), (".png", None), (".mp4", "Video/MP4"), (".jpg", "video/mp4"),
    (".mp3", None), (".bin", "application/octet-stream"), (".MOV", None), (".txt", None),
)


def _case(column: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'") for i, v in enumerate(values)
    )
    return f"CASE {column} {arms} END"


# --- expression helpers -----------------------------------------------------
def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def compact(norm: str) -> str:
    return f"CASE WHEN length({norm}) <= 500 THEN {norm} ELSE rtrim(left({norm}, 499)) || '…' END"


def sentence(norm: str) -> str:
    head = f"regexp_extract({norm}, '^(.*?[。！？.!?])', 1)"
    return f"left(CASE WHEN {head} = '' THEN {norm} ELSE {head} END, 500)"


def language(x: str) -> str:
    cjk = f"len(regexp_extract_all({x}, '[{CJK}]'))"
    latin = f"len(regexp_extract_all({x}, '[A-Za-z]'))"
    return f"CASE WHEN {cjk} > 0.25 * {latin} THEN 'zh' WHEN {latin} > 0 THEN 'en' ELSE 'unknown' END"


def tokens(x: str) -> str:
    return (
        f"list_concat(regexp_extract_all(lower({x}), '[a-z][a-z0-9_-]{{2,}}'),"
        f" regexp_extract_all({x}, '[{CJK}]{{2,8}}'))"
    )


def authority(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def host(x: str) -> str:
    return (
        f"nullif(rtrim(lower(regexp_extract(regexp_replace({authority(x)}, '^.*@', ''), '^([^:]*)', 1)), '.'), '')"
    )


def below(h: str, *domains: str) -> str:
    return "coalesce(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ", false)"


def pct(x: str) -> str:
    return f"replace(replace(replace({x}, ':', '%3A'), '/', '%2F'), '?', '%3F')"


EPOCH_US = "epoch_us(ts)"
CATALOG = ", ".join(
    f"('{d}', '{key}', '{name}', '{extractor}', '{level}')"
    for key, name, domains, extractor, _, level in PLATFORMS
    for d in domains
)

VIEW_SQL: dict[str, str] = {
    "posts": "SELECT doc_id AS request_id, text AS post_text FROM documents",
    "posts_cjk": f"""SELECT doc_id AS request_id,
        text || ' ' || substr('{CJK_SUFFIX}', 1, CAST(1 + doc_id % 12 AS INT)) AS post_text FROM documents""",
    "artifacts": f"""SELECT request_id, artifact_index, source, lang, n_chars,
        '/media/' || CASE WHEN source = 'src5' AND artifact_index = 1 THEN '../outside/' ELSE './' END
          || source || '/' || request_id || '-' || artifact_index || ext AS path,
        declared AS media_type, size_bytes, sha256, text
      FROM (SELECT doc_id AS request_id, i AS artifact_index, source, lang, n_chars, text,
              {_case("(doc_id + i) % 8", [k[0] for k in KINDS])} AS ext,
              {_case("(doc_id + i) % 8", [k[1] for k in KINDS])} AS declared,
              n_chars AS size_bytes, sha256(text) AS sha256
            FROM (SELECT *, unnest(generate_series(1, 1 + doc_id % 3)) AS i FROM documents))""",
    "files": """SELECT replace(replace(path, '/./', '/'), '/media/../', '/') AS path,
        size_bytes + CASE WHEN lang = 'de' AND artifact_index = 3 THEN 1 ELSE 0 END AS length,
        upper(CASE WHEN lang = 'es' AND artifact_index = 1 THEN sha256(sha256) ELSE sha256 END) AS sha256,
        NOT (source = 'src9' AND artifact_index = 2) AS is_regular
      FROM artifacts WHERE NOT (source = 'src3' AND artifact_index = 2)""",
    "detected": """SELECT request_id, artifact_index, path, media_type AS declared,
        lower(coalesce(media_type, CASE ext WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png'
          WHEN '.mp4' THEN 'video/mp4' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.mov' THEN 'video/quicktime'
          WHEN '.txt' THEN 'text/plain' WHEN '.bin' THEN 'application/octet-stream' END)) AS known, ext
      FROM (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM artifacts)""",
    "media": """SELECT request_id, artifact_index, path,
        CASE WHEN starts_with(known, 'image/') OR ext IN ('.jpg', '.png') THEN 'image'
             WHEN starts_with(known, 'video/') OR ext IN ('.mp4', '.mov') THEN 'video'
             WHEN starts_with(known, 'audio/') OR ext IN ('.mp3') THEN 'audio' ELSE 'unknown' END AS modality,
        CASE WHEN starts_with(known, 'image/') THEN known WHEN ext IN ('.jpg', '.png') THEN 'image/unknown'
             WHEN starts_with(known, 'video/') THEN known WHEN ext IN ('.mp4', '.mov') THEN 'video/unknown'
             WHEN starts_with(known, 'audio/') THEN known WHEN ext IN ('.mp3') THEN 'audio/unknown'
             ELSE known END AS media_type
      FROM detected""",
    "urls": "SELECT page_id AS request_id, url FROM pages",
    "alt_urls": f"""SELECT page_id AS request_id, 'https://' || {_case("page_id % 3", list(VIDEO_SITES))}
        || CASE WHEN page_id % 5 = 0 THEN '/video/' || page_id || '?from=feed' WHEN page_id % 7 = 0
             THEN '/jingxuan?modal_id=x' || page_id ELSE '/jingxuan?tab=1&modal_id=' || page_id END AS url
      FROM pages""",
    "share_text": """SELECT page_id AS request_id,
        CASE WHEN page_id % 4 = 0 THEN '复制打开 http://xhslink.com/m/' || page_id || ') ，复制本条信息'
          ELSE '打开查看 ' || url || '，看视频！' END AS shared FROM pages""",
    "play_pages": f"""SELECT page_id, html || CASE WHEN page_id % 6 = 0 THEN '' ELSE
          '%22awemeId%22%3A%22' || page_id || '%22%22playAddr%22%3A%5B%7B%22src%22%3A%22'
          || {pct("CASE WHEN page_id % 4 = 0 THEN replace(url, 'http://', 'https://') ELSE 'https://v26-web.douyinvod.com/a+b/' || page_id || '?x=1' END")}
          || '%22' END AS html FROM pages""",
    "dns": """SELECT lower(replace(s_name, '#', '-')) || '.example.com' AS host,
        CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE CASE s_suppkey % 9 WHEN 0 THEN '8.8.' WHEN 1 THEN '10.1.' WHEN 2 THEN '127.0.'
          WHEN 3 THEN '198.18.' WHEN 4 THEN '100.64.' WHEN 5 THEN '203.0.' WHEN 6 THEN '192.168.'
          WHEN 7 THEN '172.15.' ELSE '224.0.' END
          || s_suppkey % 256 || '.' || s_nationkey END AS ip FROM supplier""",
    "calls": """SELECT event_id AS call_id, user_id || ':' || event_type AS key, epoch_us(ts) AS ts FROM events""",
    "progress": """SELECT event_id, user_id AS job, epoch_us(ts) AS ts,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'finished' ELSE 'downloading' END AS status,
        value AS downloaded, CASE WHEN event_type = 'view' THEN NULL ELSE 500.0 END AS total,
        CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 300.0 END AS estimate
      FROM events""",
    "catalog": f"SELECT * FROM (VALUES {CATALOG}) c(domain, platform, display_name, extractor, support_level)",
    # One record per order; a customer's orders form pages of nested feeds.
    "record_parts": """SELECT o_orderkey, o_custkey,
        '{"id":' || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '""' ELSE '"n' || o_orderkey || '"' END
        || ',"title":' || CASE WHEN o_orderstatus = 'P' THEN '7' ELSE '"' || o_orderpriority || '"' END
        || ',"extractor_key":"' || CASE WHEN o_orderstatus = 'O' THEN 'Example' ELSE '' END || '","extractor":"generic"'
        || ',"upload_date":"' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END || '"'
        || ',"duration":' || CASE o_orderkey % 5 WHEN 0 THEN '"60"' WHEN 1 THEN 'null' ELSE CAST(o_orderkey % 7000 AS VARCHAR) || '.5' END
        || ',"view_count":' || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '"10"' WHEN 2 THEN 'true' ELSE CAST(o_custkey AS VARCHAR) || '.75' END
        || ',"description":' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '"About \\"' || o_orderkey || '\\"\\n"' END
        || ',"uploader":"' || o_custkey || '","uploader_id":' || CASE WHEN o_orderkey % 2 = 0 THEN '"u' || o_orderkey || '"' ELSE CAST(o_orderkey AS VARCHAR) END
        || ',"thumbnail":"' || CASE WHEN o_orderkey % 7 = 0 THEN 'data' ELSE 'http' END || '://img.example.com/' || o_orderkey
        || '","like_count":' || CASE o_orderkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '"7"' END
        || ',"repost_count":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE CAST(o_orderkey * 1000000007 AS VARCHAR) END
        || ',"comment_count":-' || o_orderkey || '.5,"score":"""
    + f"{LONG_DECIMAL}' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '1"
    + ""","webpage_url":"' || CASE WHEN o_orderkey % 6 = 0 THEN 'ftp' ELSE 'https' END || '://www.example.com/p/' || o_orderkey || '"}' AS leaf
      FROM orders""",
    "feeds": """SELECT c_custkey AS request_id, url_index, CASE c_mktsegment
          WHEN 'BUILDING' THEN inner_json
          WHEN 'MACHINERY' THEN '{"entries":[' || inner_json || ',5]}'
          WHEN 'FURNITURE' THEN '{"entries":[{"entries":[]},{"entries":[' || inner_json || ']}]}'
          WHEN 'HOUSEHOLD' THEN repeat('{"entries":[', 8) || inner_json || repeat(']}', 8)
          ELSE '{"id":"solo","entries":"none"}' END AS raw
      FROM (SELECT o_custkey, CAST(1 + o_orderkey // 8192 AS BIGINT) AS url_index,
              '{"entries":[' || string_agg(leaf, ',' ORDER BY o_orderkey) || ']}' AS inner_json
            FROM record_parts GROUP BY ALL) JOIN customer ON o_custkey = c_custkey""",
    "probe_logs": """SELECT event_id, CASE event_type
          WHEN 'click' THEN '{"format":{"duration":"' || value || '"},"streams":[{"codec_type":"audio"},{"codec_type":"video","width":' || user_id * 10 || ',"height":"' || user_id || '"}]}'
          WHEN 'view' THEN '{"format":{},"streams":[]}'
          WHEN 'error' THEN 'invalid data found'
          ELSE 'Input #0 Duration: 00:' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') || ':07.25, start' || chr(10)
            || ' Stream #0:0 Video: h264 (High), yuv420p, ' || (100 + user_id) || 'x' || (200 + user_id) || ', 25 fps' END AS log
      FROM events""",
    "durations": """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN -value ELSE value END AS duration FROM events""",
    "model_replies": """SELECT d.doc_id AS request_id,
        CASE WHEN d.doc_id % 11 = 0 THEN '{"language": "en", ' ELSE
          CASE WHEN d.doc_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END
          || '{"language":"' || lang || '","summary":"About ' || source || '","topics":["' || source || '","' || upper(source) || '","Sale"],'
          || '"entities":["' || lang || '"],"sentiment":"' || CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END || '",'
          || CASE WHEN quality = 1 THEN '"commercial_intent":"promotion",' ELSE '' END
          || '"safety_flags":' || CASE WHEN toxic = 1 THEN '["toxicity"," "]' ELSE '[]' END
          || ',"confidence":' || CASE WHEN d.doc_id % 13 = 0 THEN '1.5' WHEN quality = 1 THEN '0.91' ELSE '0.4' END
          || ',"evidence_refs":["post-text-1","ocr-1-1","ocr-9-9"],"extra":1}'
          || CASE WHEN d.doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS reply,
        CASE WHEN source = 'src14' THEN 'TimeoutError' END AS error
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "turns": """SELECT conv_id AS request_id, CAST(1 + turn // 4 AS INT) AS artifact_index, turn AS seg_no,
        10.0 * turn AS start_seconds, 10.0 * turn + 5.0 AS end_seconds, text FROM conversations""",
    "messages": """SELECT event_id, CASE event_type
          WHEN 'error' THEN 'ERROR: [twitter] ' || event_id || ': No video could be found in this tweet'
          WHEN 'click' THEN 'Fresh cookies (not necessarily logged in) are needed ' || user_id
          WHEN 'view' THEN 'Unsupported URL: https://host' || user_id || '.example.com/a?b=' || event_id || ' stop'
          WHEN 'signup' THEN 'No video formats found! see http://a.b/' || user_id || ' and https://c.d/' || repeat('x', CAST(user_id AS INT) * 5)
          ELSE 'timed out' END AS message FROM events""",
}
