"""SQL that gives the same rows as some of the queries, by comparing all with all."""

from __future__ import annotations

# Everything that links lead to, from every id of a table.
REACH = """reach(id, seen) AS (
  SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
), classes AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

VECTORS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS length FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.98
), nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}, n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM classes LEFT JOIN n ON n.a = id
"""

SHINGLES_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM classes LEFT JOIN n ON n.doc_id = id
"""

PAGES_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS kept, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
      >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to FROM m
"""


def urls_sql(rules: list[tuple[str, str]], listed: list[str]) -> str:
    """Verdicts by comparing every address with every rule and listed host."""
    values = ", ".join(f"('{rule}', '{verdict}', {i})" for i, (rule, verdict) in enumerate(rules))
    hosts = ", ".join(f"('{x}')" for x in listed)
    return rf"""
WITH r AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM (VALUES {values}) t(rule, verdict, i)
), l AS (SELECT * FROM (VALUES {hosts}) t(h)), rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT page_id, host, path, (SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM r
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
    (SELECT count(*) FROM l WHERE host = h OR ends_with(host, '.' || h)) AS n FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
