"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

# Distinct runs of three words, pairs with their intersections, and reachability.
_NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
runs AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM split),
sized AS (SELECT doc_id, len(shingles) AS n, list_sort(shingles) AS shingles FROM runs),
classes AS (
  SELECT shingles, n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY ALL),
each AS (SELECT rep, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.rep AS one, b.rep AS two FROM each a JOIN each b ON a.shingle = b.shingle AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
paths AS (SELECT one, two FROM links UNION ALL SELECT two, one FROM links),
reached AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION SELECT r.node, b.two FROM reached r JOIN paths b ON r.other = b.one),
least_of AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles,
  coalesce(l.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM sized s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN least_of l ON c.rep = l.node
"""

# Twenty bits, five hexadecimal digits, are four characters of base32.
_WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM payloads GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> (15 - i % 4 * 5)::INTEGER) & 31) + 1 AS BIGINT),
    1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN firsts USING (hex)
"""

# All pairs of an anchor and a row; products of whole numbers in doubles are exact.
_NEGATIVES = r"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS is_same, b.vec_id,
    CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE is_same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT is_same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_near_duplicates": _NEAR_DUPLICATES,
    "op3_warc_normaliser": _WARC,
    "op11_hard_negatives": _NEGATIVES,
}
