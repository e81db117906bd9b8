"""Sources and catalog queries.

File-format queries first let Spark write the driver's tables in the format
(table documents, truth map, CSV folders, link files) into a fresh folder
under the shared checkpoint directory, then read them back with the loader;
the reference SQL is computed on the tables the files were written from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakejoin.functions.catalog import infer_base_id, infer_partition, split_column_key
from lakejoin.lake import Lake
from lakejoin.operators import catalog as C
from lakejoin.operators.encode import key_rows
from lakejoin.operators.profile import by_column, short_key
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.registry import register
from lakejoin.session import checkpoint_dir, cut_lineage
from lakejoin.sources import testdata as T
from lakejoin.sources.csv_tables import read_csv_tables, read_links
from lakejoin.sources.json_tables import (ragged_to_rows, read_table_documents, read_truth, write_array, write_table_documents,
                                          write_truth)

STAR = O.lake_ctes("star")
EVENTS = O.lake_ctes("events")
CONV = O.lake_ctes("conv")


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lakejoin-{name}-{uuid.uuid4().hex}"


# ---- S1 / S11 table documents -------------------------------------------------------
@register("load_tables_json", f"""WITH {EVENTS}
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS BIGINT) AS row_idx,
       col_idx, col_name, value FROM cells""")
def load_tables_json(spark, sf):
    path = scratch(spark, "docs")
    write_table_documents(T.events_lake(spark, sf), path)
    lake = read_table_documents(spark, path, "row_major", "last")
    return lake.cells.select("table_id", "row_idx", "col_idx", "col_name", "value")


@register("load_tables_json_splits", f"""WITH {EVENTS}
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS BIGINT) AS row_idx,
       col_idx, col_name, value FROM cells""")
def load_tables_json_splits(spark, sf):
    """The whole lake as one file, an array of all its tables, read back in splits of at most 64 KB."""
    path = scratch(spark, "docs-one")
    write_table_documents(T.events_lake(spark, sf), path, n_files=1)
    keys = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        cells = cut_lineage(read_table_documents(spark, path, "row_major", "last").cells)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return cells.select("table_id", "row_idx", "col_idx", "col_name", "value")


@register("load_tables_json_catalog", f"""WITH {EVENTS}
SELECT t.table_id, CASE WHEN contains(t.table_id, '-') THEN split_part(t.table_id, '-', 1)
                        WHEN contains(t.table_id, '_') THEN split_part(t.table_id, '_', 1) ELSE t.table_id END AS base_id,
       CASE WHEN split_part(t.table_id, '-', 2) IN ('top', 'middle', 'bottom') THEN split_part(t.table_id, '-', 2)
            ELSE 'unknown' END AS partition,
       CAST((SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) AS INTEGER) AS n_cols,
       CAST((SELECT count(DISTINCT row_idx) FROM cells c WHERE c.table_id = t.table_id) AS BIGINT) AS n_rows,
       k.key_pos, k.col_name
FROM tables t JOIN columns k ON k.table_id = t.table_id""")
def load_tables_json_catalog(spark, sf):
    path = scratch(spark, "docs")
    write_table_documents(T.events_lake(spark, sf), path)
    lake = read_table_documents(spark, path, "row_major", "last")
    return (lake.tables.select("table_id", "base_id", "partition", "n_cols", "n_rows")
            .join(lake.columns.select("table_id", "key_pos", "col_name"), "table_id"))


@register("load_tables_json_column_major", f"""WITH {CONV}
SELECT table_id, row_idx, col_idx, col_name, value FROM (
  SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS BIGINT) AS row_idx,
         col_idx, col_name, value FROM cells)""")
def load_tables_json_column_major(spark, sf):
    """The same tables written column-major (``cells[c][r]``)."""
    lake = T.conversations_lake(spark, sf)
    path = scratch(spark, "docs-cm")
    cols = lake.columns.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "col_name"))).alias("c"))
    vals = (lake.cells.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "value"))).alias("v"))
            .groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.transform("v", lambda x: x["value"]).alias("vals")))).alias("cv")))
    docs = cols.join(vals, "table_id").select(F.to_json(F.struct(
        "table_id", F.transform("c", lambda x: x["col_name"]).alias("columns"),
        F.transform("cv", lambda x: x["vals"]).alias("cells"))).alias("doc"))
    write_array(docs, path, wrapped=True)
    out = read_table_documents(spark, path, "column_major", "none")
    return out.cells.select("table_id", "row_idx", "col_idx", "col_name", "value")


# ---- S4 / S5 truth files -------------------------------------------------------------
@register("load_truth_map", f"""WITH truth AS ({O.star_truth()}), tq AS ({O.star_truth_queries()})
SELECT tq.query_id, t.cand_id, t.pos FROM tq LEFT JOIN truth t ON t.query_id = tq.query_id""")
def load_truth_map(spark, sf):
    # truth derived from the declared links; queries = the star tables read from sf
    lake = T.star_lake(spark, sf)
    tq = lake.tables.select(F.col("table_id").alias("query_id"))
    path = scratch(spark, "truth")
    write_truth(T.star_truth(spark, sf), tq, path)
    truth, queries = read_truth(spark, path)
    return queries.join(truth, "query_id", "left").select("query_id", "cand_id", "pos")


# ---- S8 CSV folders and S10 link files ---------------------------------------------------
@register("load_csv_folder", f"""WITH {CONV}
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) - 1 AS BIGINT) AS row_idx,
       col_idx, col_name, value FROM cells""")
def load_csv_folder(spark, sf):
    lake = T.conversations_lake(spark, sf)
    path = scratch(spark, "csv")
    wide = (lake.cells.groupBy("table_id", "row_idx")
            .agg(F.max(F.when(F.col("col_idx") == 0, F.col("value"))).alias("role"),
                 F.max(F.when(F.col("col_idx") == 1, F.col("value"))).alias("text")))
    # a file a table: the number of tasks is given, or few bytes would be few tasks however many
    # files they make; version 2 lets each task put its files in place, not the driver all of them
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    (wide.repartition(n, "table_id").sortWithinPartitions("table_id", "row_idx")
     .select("table_id", "role", "text")
     .write.mode("overwrite").partitionBy("table_id").option("header", True).option("escape", '"')
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    loaded, _ = read_csv_tables(spark, path, "folder")
    tid = F.regexp_extract("table_id", r"table_id=([^/]+)/", 1)
    return loaded.cells.select(tid.alias("table_id"), "row_idx", "col_idx", "col_name", "value")


@register("load_links", f"""{O.star_links()}""")
def load_links(spark, sf):
    lake = T.star_lake(spark, sf)
    path = scratch(spark, "links")
    links = T.star_links(spark, sf)
    # table names as a CSV export would write them: with a .csv suffix and padding
    (links.select(F.concat(F.lit(" "), F.col("table1"), F.lit(".csv")).alias("a"), F.col("table2").alias("b"),
                  F.col("column1").alias("c"), F.concat(F.col("column2"), F.lit(" ")).alias("d"))
     .coalesce(1).write.mode("overwrite").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_links(spark, path, lake).select("table1", "column1", "table2", "column2")


# ---- C1 / C2 / C7 name expressions -----------------------------------------------------------
@register("parse_column_key", f"""WITH {STAR},
keys AS (SELECT DISTINCT table_id || '::' || col_name AS key FROM cells UNION ALL SELECT DISTINCT table_id AS key FROM cells)
SELECT key, CASE WHEN contains(key, '::') THEN split_part(key, '::', 1) ELSE key END AS table_id,
       CASE WHEN contains(key, '::') THEN substring(key, strpos(key, '::') + 2) ELSE '' END AS col_name FROM keys""")
def parse_column_key(spark, sf):
    lake = T.star_lake(spark, sf)
    cols = lake.cells.select("table_id", "col_name").distinct()
    keys = (cols.select(F.concat("table_id", F.lit("::"), "col_name").alias("key"))
            .unionByName(cols.select(F.col("table_id").alias("key")).distinct()))
    t, c = split_column_key(F.col("key"))
    return keys.select("key", t.alias("table_id"), c.alias("col_name"))


@register("infer_base_partition", f"""WITH {EVENTS}
SELECT table_id, CASE WHEN contains(table_id, '-') THEN split_part(table_id, '-', 1)
                      WHEN contains(table_id, '_') THEN split_part(table_id, '_', 1) ELSE table_id END AS base_id,
       CASE WHEN split_part(table_id, '-', 2) IN ('top', 'middle', 'bottom') THEN split_part(table_id, '-', 2)
            ELSE 'unknown' END AS partition
FROM (SELECT DISTINCT table_id FROM tables UNION SELECT DISTINCT 'conv_' || CAST(conv_id AS VARCHAR) FROM conversations
      UNION SELECT DISTINCT 'orders-' || (['top', 'middle', 'bottom'])[o_custkey % 3 + 1] || '-' || lower(o_orderstatus) FROM orders)""")
def infer_base_partition(spark, sf):
    ev = T.events_lake(spark, sf).tables.select("table_id")
    cv = T.read(spark, sf, "conversations").select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("table_id"))
    part = F.element_at(F.array(F.lit("top"), F.lit("middle"), F.lit("bottom")), (F.col("o_custkey") % 3 + 1).cast("int"))
    od = T.read(spark, sf, "orders").select(F.concat(F.lit("orders-"), part, F.lit("-"), F.lower("o_orderstatus")).alias("table_id"))
    ids = ev.union(cv).union(od).distinct()
    return ids.select("table_id", infer_base_id(F.col("table_id")).alias("base_id"),
                      infer_partition(F.col("table_id")).alias("partition"))


# ---- C9 / C10 / C11 / C12 / C14 / S12 ------------------------------------------------------------
def _with_values(keys, lake):
    """The chosen columns that have cells, with their number of distinct values.  Long
    values are told apart by :func:`~lakejoin.operators.profile.short_key`, which is much shorter."""
    ids = ["table_id", "col_idx"]
    keys = cut_lineage(keys)
    short = lake.cells.select(*ids, short_key(F.col("value")).alias("value"))
    n = (by_column(short, keys.select(*ids).distinct(), "left_semi", ids)
         .groupBy(*ids).agg(F.count_distinct("value").alias("n_values")))
    return keys.join(n, ids).select("table_id", "key_pos", "col_idx", "col_name", "n_values")


@register("key_columns_a", f"""WITH {STAR}
SELECT k.table_id, k.key_pos, k.col_idx, k.col_name, count(DISTINCT c.value) AS n_values
FROM columns k JOIN cells c ON c.table_id = k.table_id AND c.col_idx = k.col_idx WHERE k.key_pos IS NOT NULL GROUP BY ALL""")
def key_columns_a(spark, sf):
    lake = T.star_lake(spark, sf)
    return _with_values(C.key_columns_a(lake), lake)


@register("key_columns_b", f"""WITH {STAR}, t AS (SELECT table_id, count(*) AS n_cols FROM columns GROUP BY ALL),
ov AS (SELECT * FROM (VALUES (0, 0), (1, 2), (2, 5)) v(key_pos0, idx))
SELECT c.table_id, CAST(row_number() OVER (PARTITION BY c.table_id ORDER BY ov.key_pos0) - 1 AS INTEGER) AS key_pos,
       c.col_idx, c.col_name, nv.n_values
FROM t JOIN ov ON ov.idx >= 0 AND ov.idx < t.n_cols JOIN columns c ON c.table_id = t.table_id AND c.col_idx = ov.idx
JOIN (SELECT table_id, col_idx, count(DISTINCT value) AS n_values FROM cells GROUP BY ALL) nv
  ON nv.table_id = c.table_id AND nv.col_idx = c.col_idx""")
def key_columns_b(spark, sf):
    """C10 with a key-index override (0, 2, 5): out-of-range indices dropped per table."""
    lake = T.star_lake(spark, sf)
    return _with_values(C.key_columns_b(lake, [0, 2, 5]), lake)


@register("key_rows", f"""WITH {CONV}
SELECT c.table_id, c.row_idx, CAST(k.key_pos AS INTEGER) AS key_pos, c.col_name, coalesce(c.value, '') AS value
FROM cells c JOIN columns k ON k.table_id = c.table_id AND k.col_idx = c.col_idx AND k.key_pos IS NOT NULL""")
def key_rows_q(spark, sf):
    return key_rows(T.conversations_lake(spark, sf)).select(
        "table_id", "row_idx", F.col("key_pos").cast("int").alias("key_pos"), "col_name", "value")


@register("valid_tables", f"""WITH {CONV}
SELECT t.table_id, CAST((SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) AS INTEGER) AS n_cols,
       (SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) >= 2
       AND EXISTS (SELECT 1 FROM cells c WHERE c.table_id = t.table_id) AS valid
FROM tables t""")
def valid_tables(spark, sf):
    return C.valid_tables(T.conversations_lake(spark, sf), 2)


@register("valid_table_counts", f"""WITH {CONV},
v AS (SELECT t.table_id, (SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) >= 2
             AND EXISTS (SELECT 1 FROM cells c WHERE c.table_id = t.table_id) AS valid FROM tables t)
SELECT count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_skipped FROM v""")
def valid_table_counts(spark, sf):
    """Valid and skipped tables of the conversation lake."""
    return C.validity_counts(C.valid_tables(T.conversations_lake(spark, sf), 2))


def _keys_only(lake: Lake) -> Lake:
    kc = lake.key_columns().select("table_id", "col_idx")
    return Lake(lake.tables, lake.columns.join(kc, ["table_id", "col_idx"], "left_semi"),
                lake.cells.join(kc, ["table_id", "col_idx"], "left_semi"))


def _merged_cells(lake: Lake):
    return lake.cells.groupBy("table_id", "col_idx", "col_name").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("value").alias("n_values"))


@register("merge_tables_lake_wins", f"""WITH {STAR}
SELECT c.table_id, c.col_idx, c.col_name, count(*) AS n_cells, count(DISTINCT c.value) AS n_values
FROM cells c JOIN columns k ON k.table_id = c.table_id AND k.col_idx = c.col_idx AND k.key_pos IS NOT NULL GROUP BY ALL""")
def merge_tables_lake_wins(spark, sf):
    full = T.star_lake(spark, sf)
    return _merged_cells(C.merge_lakes(full, _keys_only(full), "second"))


@register("merge_tables_first_wins", f"""WITH {STAR}
SELECT table_id, col_idx, col_name, count(*) AS n_cells, count(DISTINCT value) AS n_values FROM cells GROUP BY ALL""")
def merge_tables_first_wins(spark, sf):
    full = T.star_lake(spark, sf)
    return _merged_cells(C.merge_lakes(full, _keys_only(full), "first"))


@register("ragged_to_rows", f"""WITH {CONV},
sel AS (SELECT DISTINCT table_id, v.pos, v.col_idx FROM columns, (VALUES (0, 1), (1, 0), (2, 7)) v(pos, col_idx)),
lens AS (SELECT c.table_id, max(c.row_idx) AS max_row FROM cells c WHERE c.col_idx IN (1, 0, 7) GROUP BY ALL),
grid AS (SELECT s.table_id, s.pos, s.col_idx, CAST(r.row_idx AS BIGINT) AS row_idx FROM sel s JOIN lens l ON l.table_id = s.table_id,
         unnest(range(0, l.max_row + 1)) r(row_idx))
SELECT g.table_id, g.row_idx, g.pos, coalesce(c.value, '') AS value FROM grid g
LEFT JOIN cells c ON c.table_id = g.table_id AND c.col_idx = g.col_idx AND c.row_idx = g.row_idx""")
def ragged_to_rows_q(spark, sf):
    """S12 on the conversation tables, columns (1, 0, 7): the missing column pads ''."""
    return ragged_to_rows(T.conversations_lake(spark, sf), [1, 0, 7])
