"""SQL with the same rows as the queries of ``catalog``, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op5_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""

# Windows are compared as word lists; an item shorter than a window is compared at its own length.
SQL["op2_decontamination"] = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
lengths AS (SELECT DISTINCT least(13, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS x
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k
        FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, m, k, item_id FROM places JOIN windows USING (m, x)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
       coalesce(hi.h, sha256('')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words hw USING (doc_id) LEFT JOIN hit_items hi USING (doc_id)"""

# The pages keep their main text in one article; its only markup is paragraphs, breaks, one heading and bold type.
SQL["op1_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
t AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(replace(replace(x, '<b>', ''), '</b>', ''), '</?(p|br|h1)>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'),
    '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

# Every pair of texts that share a shingle is counted; components follow the links to the smallest id.
SQL["op10_jaccard_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(4, len(w)) - 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (x)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
reach AS (SELECT doc_id, doc_id AS component FROM d UNION SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(component) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL"""

# The damage is known: which records it hits, and where they lie in their files.
SQL["op3_warc_fixity"] = """
WITH r AS (
  SELECT page_id, html, page_id // 1000 AS f, strlen(
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS n FROM pages),
p AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY page_id) - 1 AS record_no,
         sum(n) OVER (PARTITION BY f ORDER BY page_id) - n AS first FROM r)
SELECT 'pages-' || f || '.warc' AS file, record_no,
       CASE WHEN f % 3 = 1 AND page_id % 1000 >= 990 THEN 'missing' ELSE 'changed' END AS status,
       first::BIGINT AS first, (first + n)::BIGINT AS "end",
       CASE WHEN f % 3 = 1 AND page_id % 1000 >= 990 THEN -n
            ELSE strlen(broken) - strlen(coalesce(html, '')) + strlen(strlen(broken)::VARCHAR) - strlen(strlen(coalesce(html, ''))::VARCHAR)
       END::BIGINT AS shift
FROM (SELECT *, CASE WHEN page_id % 23 = 7 AND length(html) > 0 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END
                || CASE WHEN page_id % 29 = 3 THEN '~' ELSE '' END AS broken FROM p)
WHERE (f % 3 = 1 AND page_id % 1000 >= 990) OR broken <> coalesce(html, '')"""

_USABLE = (
    "embedding IS NOT NULL AND len(embedding) > 0 AND "
    "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
)

# Cosines of all pairs; components follow the links to the smallest id.
SQL["op11_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, min(c) AS component_id, e.vec_id = min(c) AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) JOIN reach USING (vec_id) GROUP BY e.vec_id, n"""

# Every anchor is scored against every row.
SQL["op13_hard_negatives"] = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3"""
