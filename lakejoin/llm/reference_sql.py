"""DuckDB SQL of op8 and op10: the contracts read literally, over the whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


# Sets are compared once for all documents that share one; links count common shingles.
JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS sh FROM d),
c AS (SELECT doc_id, len(sh) AS n, sh, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sh) END AS rep FROM s),
u AS (SELECT rep, n, unnest(sh) AS x FROM c WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM c UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, comp.component_id FROM c JOIN comp ON c.rep = comp.rep"""

# Windows of all sizes that items have (13, or an item's own length below it).
WINNOWING_SQL = rf"""
WITH d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS g
       FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT doc_id, p, dw.size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""
