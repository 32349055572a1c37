"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .decontam import _UNIT

#: Closed form of the water filling: sources sorted by the level at which they reach their cap.
OP8 = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))) AS ord
  FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT source, source_size,
         CAST(1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM sources
), sorted AS (
  SELECT *, COALESCE(SUM(3.0 * source_size) OVER w, 0) AS fixed_before,
         SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS free_weight,
         SUM(CAST(source_size AS DOUBLE)) OVER () AS total
  FROM weighted
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, weight, source_size, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT ARG_MIN((total - fixed_before) / free_weight, fixed_before) AS water
  FROM sorted WHERE (total - fixed_before) / free_weight * weight < 3.0 * source_size
), targets AS (
  SELECT source, source_size, weight, LEAST(weight * COALESCE(water, 0), 3.0 * source_size) AS target
  FROM weighted, level
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(FLOOR(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), running AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         SUM(size) OVER (PARTITION BY r.source ORDER BY ord, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         SUM(size) OVER (PARTITION BY r.source ORDER BY substr(ord, 1, 3)) AS bucket_run
  FROM rows r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
), copied AS (
  SELECT *, CAST(LEAST(3, whole + CASE
           WHEN bucket_run <= extra THEN 1
           WHEN substr(ord, 1, 3) > (SELECT MIN(substr(x.ord, 1, 3)) FROM running x
                                     WHERE x.source IS NOT DISTINCT FROM running.source AND x.bucket_run > x.extra) THEN 0
           WHEN run - size / 2.0 <= extra THEN 1 ELSE 0 END) AS INTEGER) AS copies
  FROM running
)
SELECT doc_id, source, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM copied
"""

#: Word by word: kinds of words, windows as lists, slots by their least and largest partners.
OP6 = r"""
WITH sides AS (
  SELECT 'd' AS side, CAST(ROW_NUMBER() OVER () AS BIGINT) AS rid, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', CAST(ROW_NUMBER() OVER () AS BIGINT), item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), split AS (
  SELECT side, rid, id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM sides WHERE text IS NOT NULL
), raw AS (
  SELECT side, rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), first_kinds AS (
  SELECT *, CASE
      WHEN i > 1 AND right(lag(w) OVER pos, 1) NOT IN ('.', '!', '?', ':')
           AND regexp_full_match(w, '[^\p{L}\p{N}]*\p{Lu}\p{L}*[^\p{L}\p{N}]*') THEN 'p'
      WHEN regexp_full_match(w, '[^\p{L}\p{N}]*{number}[^\p{L}\p{N}]*') THEN 'n'
      WHEN regexp_full_match(w, '[^\p{L}\p{N}]*{number}{unit}[^\p{L}\p{N}]*') THEN 'q'
      ELSE 'w' END AS kind1
  FROM raw WINDOW pos AS (PARTITION BY side, rid ORDER BY i)
), kinds AS (
  SELECT side, rid, w, i, CASE WHEN kind1 = 'w' AND lag(kind1) OVER pos = 'n'
      AND regexp_full_match(w, '[^\p{L}\p{N}]*{unit}[^\p{L}\p{N}]*') THEN 'u' ELSE kind1 END AS kind
  FROM first_kinds WINDOW pos AS (PARTITION BY side, rid ORDER BY i)
), words AS (
  SELECT side, rid, CAST(i AS BIGINT) AS i, kind,
         lower(CASE WHEN regexp_matches(w, '[\p{L}\p{N}]') THEN regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') ELSE w END) AS x,
         lower(CASE WHEN kind = 'w' THEN regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')
                    ELSE regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') END) AS v
  FROM kinds
), texts AS (
  SELECT side, rid, list(CASE WHEN kind = 'w' THEN '=' || v ELSE kind END ORDER BY i) AS t, list(x ORDER BY i) AS xs, COUNT(*) AS n
  FROM words GROUP BY side, rid
), sizes AS (
  SELECT DISTINCT LEAST(n, 8) AS k FROM texts WHERE side = 'b'
), windows AS (
  SELECT side, rid, k, p, list_slice(t, p, p + k - 1) AS win, list_slice(xs, p, p + k - 1) AS exact,
         len(list_filter(list_slice(t, p, p + k - 1), lambda x: x[1] = '=' AND x <> '=')) >= LEAST(4, k) AS fixed
  FROM (SELECT side, rid, k, t, xs, n, unnest(range(1, n - k + 2)) AS p FROM texts, sizes
        WHERE n >= k AND (side = 'd' OR k = LEAST(n, 8)))
), same AS (
  SELECT DISTINCT d.rid AS doc, b.rid AS item, unnest(range(b.p, b.p + b.k)) AS j
  FROM windows d JOIN windows b ON d.side = 'd' AND b.side = 'b' AND d.k = b.k AND d.exact = b.exact
  WHERE NOT b.fixed AND len(list_filter(b.exact, lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) > 0
), hits AS (
  SELECT DISTINCT d.rid AS doc, b.rid AS item, d.p - b.p AS diag, unnest(range(b.p, b.p + b.k)) AS j
  FROM windows d JOIN windows b ON d.side = 'd' AND b.side = 'b' AND d.k = b.k AND d.win = b.win
  WHERE b.fixed
), pairs AS (
  SELECT h.*, b.kind, b.v AS bv, d.v AS dv FROM hits h
  JOIN words b ON b.side = 'b' AND b.rid = h.item AND b.i = h.j
  JOIN words d ON d.side = 'd' AND d.rid = h.doc AND d.i = h.j + h.diag
), judged AS (
  SELECT *, kind = 'w' OR (MIN(dv) OVER bs = MAX(dv) OVER bs AND MIN(bv) OVER ds = MAX(bv) OVER ds) AS ok
  FROM pairs WINDOW bs AS (PARTITION BY doc, item, diag, kind, bv), ds AS (PARTITION BY doc, item, diag, kind, dv)
), covered AS (
  SELECT doc, item, COUNT(DISTINCT j) AS covered
  FROM (SELECT doc, item, j FROM judged WHERE ok UNION SELECT doc, item, j FROM same) GROUP BY doc, item
), found AS (
  SELECT c.doc, COUNT(DISTINCT s.id) AS n_items, MAX(covered) AS covered_words, MIN(s.id) AS first_item
  FROM covered c JOIN texts t ON t.side = 'b' AND t.rid = c.item JOIN sides s ON s.side = 'b' AND s.rid = c.item
  WHERE covered >= CASE WHEN t.n < 8 THEN t.n WHEN t.n <= 13 THEN ceil(t.n * CAST(0.8 AS DOUBLE)) ELSE 13 END GROUP BY c.doc
)
SELECT s.id AS doc_id, f.doc IS NOT NULL AS contaminated, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
       CAST(COALESCE(covered_words, 0) AS BIGINT) AS covered_words, first_item
FROM sides s LEFT JOIN found f ON s.rid = f.doc WHERE s.side = 'd'
""".replace("{number}", "[0-9]+(?:[.,:/][0-9]+)*").replace("{unit}", _UNIT)

#: All scores of the anchors, without lists or thresholds.
OP12 = r"""
WITH vecs AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vecs a JOIN vecs r ON a.id <> r.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

#: Equal payloads by their digest.
OP10 = r"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, MAX(page_id) AS first_id FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id > p.page_id THEN f.first_id END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.payload_bytes >= 1000 AND f.payload_digest = p.payload_digest
"""

ORACLES = {"op6_template_decontamination": OP6, "op8_water_filling": OP8, "op10_warc_round_trip": OP10, "op12_hard_negatives": OP12}
