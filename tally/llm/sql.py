"""The queries that SQL can express, for DuckDB; components by a recursive reach over links."""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y
)
SELECT x AS doc_id, min(y) AS class_id, coalesce((SELECT count(*) FROM l WHERE l.x = reach.x), 0) AS n_links FROM reach GROUP BY x
"""

#: Pairs are found by their rarest strings: two similar sets share one of the first n - ceil(0.8 n) + 1 of each.
LINE_DEDUP = r"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, place, lower(trim(line)) AS t FROM raw WHERE length(trim(line)) > 0
), texts AS (
  SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM lines)
), s AS MATERIALIZED (
  SELECT DISTINCT k, substr(t, i, 9) AS g FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 8, 1) + 1)) AS i FROM texts)
), n AS MATERIALIZED (
  SELECT k, count(*) AS n FROM s GROUP BY k
), f AS (
  SELECT g, count(*) AS f FROM s GROUP BY g
), rare AS MATERIALIZED (
  SELECT k, g, n FROM (SELECT s.k, s.g, f.f, n.n, row_number() OVER (PARTITION BY s.k ORDER BY f.f, s.g) AS r FROM s JOIN f USING (g) JOIN n USING (k))
  WHERE r <= n - ceil(n * 4 / 5.0) + 1 AND f > 1
), c AS MATERIALIZED (
  SELECT DISTINCT a.k AS x, b.k AS y FROM rare a JOIN rare b ON a.g = b.g AND a.k < b.k WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), p AS (
  SELECT x, y, count(*) AS c FROM c JOIN s a ON a.k = x JOIN s b ON b.k = y AND b.g = a.g GROUP BY x, y
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 9 * c >= 4 * (a.n + b.n)
), links AS MATERIALIZED (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT k AS x, k AS y FROM texts UNION SELECT r.x, b.y FROM reach r JOIN links b ON b.x = r.y
), roots AS (
  SELECT x AS k, min(y) AS root FROM reach GROUP BY x
), ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY root ORDER BY doc_id, place) AS r FROM lines JOIN texts USING (t) JOIN roots USING (k)
), gone AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed FROM ranked WHERE r > 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id)
"""
