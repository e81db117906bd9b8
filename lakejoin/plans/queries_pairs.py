"""Training-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejoin.operators import pairs as PR
from lakejoin.operators import profile as P
from lakejoin.operators.catalog import positive_filter, valid_tables
from lakejoin.operators.order import DEFAULT_SEED, batches, seeded_key
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.queries_catalog import scratch
from lakejoin.plans.queries_text import LAKE_FREQ
from lakejoin.plans.registry import r6, register
from lakejoin.sources import testdata as T
from lakejoin.sources.csv_tables import read_links

STAR = O.lake_ctes("star")
SHUFFLE_RATE = 0.3
BATCH = 16
SEED = DEFAULT_SEED


def md5key(*parts: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{SEED}'"] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"


PAIRS_SQL = f"""truth AS ({O.star_truth()}),
kc AS (SELECT table_id, key_pos, col_name FROM columns WHERE key_pos IS NOT NULL),
pairs AS (SELECT CAST(row_number() OVER (ORDER BY t.query_id, t.pos, q.key_pos) - 1 AS BIGINT) AS pair_id,
                 t.query_id AS table1, q.col_name AS column1, t.cand_id AS table2, c.col_name AS column2, 1 AS label
          FROM truth t JOIN kc q ON q.table_id = t.query_id JOIN kc c ON c.table_id = t.cand_id AND c.key_pos = q.key_pos)"""


def star_pairs(spark, sf):
    lake = T.star_lake(spark, sf)
    return lake, PR.truth_to_pairs(T.star_truth(spark, sf), lake)


# ---- J6 -------------------------------------------------------------------------
@register("truth_to_pairs", f"WITH {STAR}, {PAIRS_SQL}\nSELECT * FROM pairs")
def truth_to_pairs(spark, sf):
    return star_pairs(spark, sf)[1]


# ---- J7 -------------------------------------------------------------------------
@register("links_to_pairs", f"""WITH l AS ({O.star_links_ordered()})
SELECT CAST(row_number() OVER (ORDER BY link_pos) - 1 AS BIGINT) AS pair_id, table1, column1, table2, column2, 1 AS label FROM l""")
def links_to_pairs(spark, sf):
    lake = T.star_lake(spark, sf)
    path = scratch(spark, "links")
    T.star_links(spark, sf).orderBy("link_pos").select("table1", "table2", "column1", "column2").coalesce(1).write.mode("overwrite").csv(path)
    return PR.links_to_pairs(read_links(spark, path, lake))


# ---- C13 ------------------------------------------------------------------------
@register("positive_filter", f"WITH {STAR}, {PAIRS_SQL}\nSELECT * FROM pairs")
def positive_filter_q(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    noisy = (pairs.unionByName(pairs.withColumn("label", F.lit(0)))
             .unionByName(pairs.withColumn("column2", F.concat("column2", F.lit("_missing"))))
             .unionByName(pairs.withColumn("table1", F.concat("table1", F.lit("_missing")))))
    return positive_filter(noisy, lake)


# ---- G1 -------------------------------------------------------------------------
AUG_SQL = f"""{PAIRS_SQL},
npairs AS (SELECT count(*) AS n FROM pairs),
picked AS (SELECT p.* FROM (SELECT *, row_number() OVER (ORDER BY {md5key('pair_id')}, pair_id) - 1 AS o FROM pairs) p, npairs
           WHERE o < CAST(floor(n * {SHUFFLE_RATE}) AS BIGINT)),
aug AS (SELECT * FROM pairs UNION ALL
        SELECT pair_id + (SELECT max(pair_id) + 1 FROM pairs), table1 || '_shuffled', column1, table2, column2, label FROM picked)"""


@register("shuffle_augment", f"WITH {STAR}, {AUG_SQL}\nSELECT * FROM aug")
def shuffle_augment(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    return PR.augment(pairs, lake, SHUFFLE_RATE, SEED)[0]


# ---- A10 ------------------------------------------------------------------------
@register("reuse_stats", f"""WITH {STAR}, {AUG_SQL},
refs AS (SELECT table1 AS t, column1 AS c FROM aug UNION ALL SELECT table2, column2 FROM aug)
SELECT count(DISTINCT (t, c)) AS entries, count(*) AS requests,
       round(CASE WHEN count(*) > 0 THEN (1 - count(DISTINCT (t, c)) / count(*)) * 100 ELSE 0.0 END, 6) AS hit_rate FROM refs""")
def reuse_stats(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    return PR.reuse_stats(PR.augment(pairs, lake, SHUFFLE_RATE, SEED)[0]).select("entries", "requests", r6("hit_rate"))


# ---- G2 (+G1 effect on the text) ----------------------------------------------------
def _aug_cells_sql() -> str:
    return f"""augcells AS (
  SELECT * FROM cells UNION ALL
  SELECT c.table_id || '_shuffled', CAST(row_number() OVER (PARTITION BY c.table_id, c.col_name ORDER BY {md5key('c.table_id', 'c.col_name', 'c.row_idx')}, c.row_idx) - 1 AS BIGINT),
         c.col_idx, c.col_name, c.value
  FROM cells c WHERE EXISTS (SELECT 1 FROM picked p WHERE p.table1 = c.table_id AND p.column1 = c.col_name)),
augcols AS (SELECT * FROM columns UNION ALL
  SELECT c.table_id || '_shuffled', c.col_idx, c.col_name, c.description, c.key_pos FROM columns c
  WHERE EXISTS (SELECT 1 FROM picked p WHERE p.table1 = c.table_id AND p.column1 = c.col_name)),
augtabs AS (SELECT table_id, table_name, table_pos FROM tables UNION ALL
  SELECT t.table_id || '_shuffled', t.table_name, t.table_pos FROM tables t
  WHERE EXISTS (SELECT 1 FROM picked p WHERE p.table1 = t.table_id))"""


@register("shuffle_augment_cells", f"""WITH {STAR}, {AUG_SQL}, {_aug_cells_sql()}
SELECT table_id, row_idx, col_idx, col_name, value FROM augcells WHERE table_id LIKE '%\\_shuffled' ESCAPE '\\'""")
def shuffle_augment_cells(spark, sf):
    """The cells of the shuffled copies: positions 0 .. n - 1 of each column, and its values."""
    lake, pairs = star_pairs(spark, sf)
    _, lake2 = PR.augment(pairs, lake, SHUFFLE_RATE, SEED)
    return lake2.cells.where(F.col("table_id").endswith(PR.SHUFFLED_SUFFIX)).select("table_id", "row_idx", "col_idx", "col_name", "value")


@register("text_pairs", f"""WITH {STAR}, {AUG_SQL}, {LAKE_FREQ}, {_aug_cells_sql()},
need AS (SELECT table1 AS table_id, column1 AS col_name FROM aug UNION SELECT table2, column2 FROM aug),
ncells AS (SELECT c.* FROM augcells c JOIN need n ON n.table_id = c.table_id AND n.col_name = c.col_name),
ncols AS (SELECT c.* FROM augcols c JOIN need n ON n.table_id = c.table_id AND n.col_name = c.col_name),
{O.column_text_ctes(cells='ncells', columns='ncols', tables='augtabs', lake_freq='lfreq').strip()}
SELECT a.pair_id, t1.text AS text1, t2.text AS text2 FROM aug a
JOIN coltext t1 ON t1.table_id = a.table1 AND t1.col_name = a.column1
JOIN coltext t2 ON t2.table_id = a.table2 AND t2.col_name = a.column2""")
def text_pairs(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    lf = P.lake_value_frequency(lake)
    aug, lake2 = PR.augment(pairs, lake, SHUFFLE_RATE, SEED)
    return PR.text_pairs(aug, lake2, lf)


# ---- W9 / G5 ----------------------------------------------------------------------
BATCH_SQL = f"""{AUG_SQL},
b AS (SELECT pair_id, CAST(floor(o / {BATCH}) AS BIGINT) AS batch_id, CAST(o % {BATCH} AS INTEGER) AS pos_in_batch
      FROM (SELECT pair_id, row_number() OVER (ORDER BY {md5key('pair_id')}, pair_id) - 1 AS o FROM aug))"""


@register("batches", f"WITH {STAR}, {BATCH_SQL}\nSELECT * FROM b")
def batches_q(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    aug = PR.augment(pairs, lake, SHUFFLE_RATE, SEED)[0]
    return batches(aug, BATCH, [seeded_key(SEED, "pair_id"), F.col("pair_id")]).select("pair_id", "batch_id", "pos_in_batch")


@register("in_batch_negatives", f"""WITH {STAR}, {BATCH_SQL}
SELECT x.batch_id, x.pair_id AS i, y.pair_id AS j, 0 AS label FROM b x JOIN b y ON x.batch_id = y.batch_id AND x.pair_id <> y.pair_id""")
def in_batch_negatives(spark, sf):
    lake, pairs = star_pairs(spark, sf)
    aug = PR.augment(pairs, lake, SHUFFLE_RATE, SEED)[0]
    b = batches(aug.withColumn("text1", F.lit("")).withColumn("text2", F.lit("")), BATCH,
                [seeded_key(SEED, "pair_id"), F.col("pair_id")])
    return PR.in_batch_negatives(b).select("batch_id", "i", "j", "label")


# ---- G3 / G4 / W8 ---------------------------------------------------------------------
SAMPLES_PER_TABLE = 3


def samples_sql() -> str:
    ev = O.lake_ctes("events")
    return f"""{ev},
valid AS (SELECT t.table_id, t.table_pos, (SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) AS n_cols FROM tables t
          WHERE (SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) >= 2
            AND EXISTS (SELECT 1 FROM cells c WHERE c.table_id = t.table_id)),
draws AS (SELECT v.*, CAST(d.draw AS INTEGER) AS draw FROM valid v, range(0, {SAMPLES_PER_TABLE}) d(draw)),
dn AS (SELECT *, least(2 + CAST(('0x' || substr({md5key('table_id', 'draw')}, 1, 8)) AS BIGINT) % 3, n_cols) AS n FROM draws),
sel AS (SELECT dn.table_id, dn.table_pos, dn.draw, dn.n, c.col_idx, c.col_name, c.description,
               row_number() OVER (PARTITION BY dn.table_id, dn.draw ORDER BY {md5key('dn.table_id', 'dn.draw', 'c.col_idx')}, c.col_idx) AS sel
        FROM dn JOIN columns c ON c.table_id = dn.table_id),
fvg AS (SELECT table_id, col_idx, value, min(row_idx) AS first_row FROM cells GROUP BY ALL),
fvr AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY first_row) AS vr FROM fvg),
fv AS (SELECT table_id, col_idx, string_agg(value, ', ' ORDER BY vr) AS vals FROM fvr
       WHERE vr <= 10 AND value IS NOT NULL AND value <> '' GROUP BY ALL),
parts AS (SELECT s.*, CASE WHEN coalesce(fv.vals, '') <> '' THEN s.col_name || ' : ' || fv.vals END AS p,
                 CASE WHEN s.description IS NOT NULL AND regexp_replace(s.description, '^\\s+|\\s+$', '', 'g') <> ''
                      THEN s.col_name || ' : ' || regexp_replace(s.description, '^\\s+|\\s+$', '', 'g') END AS d
          FROM sel s LEFT JOIN fv ON fv.table_id = s.table_id AND fv.col_idx = s.col_idx WHERE s.sel <= s.n),
samp AS (SELECT table_id, table_pos, draw, n AS n_columns,
                coalesce(string_agg(p, ' [SEP] ' ORDER BY sel), 'empty') AS row_text,
                coalesce(string_agg(d, ' [SEP] ' ORDER BY sel), 'No description available') AS desc_text,
                string_agg(col_name, ',' ORDER BY sel) AS column_names
         FROM parts GROUP BY table_id, table_pos, draw, n),
samples AS (SELECT CAST(row_number() OVER (ORDER BY table_pos, table_id, draw) - 1 AS BIGINT) AS sample_idx, *
            FROM samp WHERE row_text <> 'empty' AND desc_text <> 'No description available')"""


def events_samples(spark, sf):
    lake = T.events_lake(spark, sf)
    return PR.multi_key_samples(lake, valid_tables(lake, 2), SAMPLES_PER_TABLE, seed=SEED)


@register("multi_key_samples", f"""WITH {samples_sql()}
SELECT sample_idx, table_id, draw, row_text, desc_text, column_names, n_columns FROM samples""")
def multi_key_samples(spark, sf):
    s = events_samples(spark, sf)
    return s.select("sample_idx", "table_id", "draw", "row_text", "desc_text",
                    F.array_join("column_names", ",").alias("column_names"), F.col("n_columns").cast("long").alias("n_columns"))


@register("description_set", f"""WITH {samples_sql()}
SELECT sample_idx, table_id, CASE WHEN desc_text = 'No description available' THEN '' ELSE desc_text END AS desc_text FROM samples""")
def description_set(spark, sf):
    return PR.description_set(events_samples(spark, sf))
