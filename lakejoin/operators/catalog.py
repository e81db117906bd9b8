"""Catalog operators (C6, C8-C14): name resolution, key-column choice, table
validity, positive-pair filter and lake merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.functions.catalog import normalize_name
from lakejoin.lake import Lake


def resolve_names(names: DataFrame, tables: DataFrame) -> DataFrame:
    """``names(link_id, name)`` -> ``(link_id, name, table_id)``: exact
    id first, then the id without '.csv'; unresolved names are dropped."""
    n = normalize_name(F.col("name"))
    cands = F.array(F.struct(F.lit(0).alias("prio"), n.alias("cand")),
                    F.struct(F.lit(1).alias("prio"),
                             F.when(n.endswith(".csv"), F.expr("substring(translate(name, '\\\\', '/'), 1, length(name) - 4)"))
                             .alias("cand")))
    ex = names.select("*", F.inline(cands)).where(F.col("cand").isNotNull())
    hit = ex.join(tables.select(F.col("table_id").alias("cand")), "cand")
    w = Window.partitionBy("link_id").orderBy("prio")
    return (hit.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("link_id", "name", F.col("cand").alias("table_id")))


def column_values(lake: Lake, table_id: str, col_name: str | None = None, col_idx: int | None = None) -> DataFrame:
    """Values of one column by name or index (empty when missing)."""
    c = lake.cells.where(F.col("table_id") == table_id)
    c = c.where(F.col("col_name") == col_name) if col_name is not None else c.where(F.col("col_idx") == col_idx)
    return c.select("row_idx", "value")


def key_columns_a(lake: Lake) -> DataFrame:
    """Declared key columns in key order (tables without keys absent)."""
    return lake.key_columns()


def key_columns_b(lake: Lake, override: list[int] | None = None) -> DataFrame:
    """Key choice per table: override (range-filtered; no valid index ->
    no key) > declared keys > all columns.  Order and repeats of both lists are
    kept: a repeated index is a key position each time.  (table_id, key_pos,
    col_idx, col_name)."""
    cols = lake.columns
    if override is not None:
        ov = F.array(*[F.lit(int(i)) for i in override]) if override else F.array().cast("array<int>")
        t = lake.tables.select("table_id", "n_cols")
        keys = t.select("table_id", F.posexplode(F.filter(ov, lambda i: (i >= 0) & (i < F.col("n_cols"))))
                        .alias("key_pos", "col_idx"))
        return keys.join(cols.select("table_id", "col_idx", "col_name"), ["table_id", "col_idx"]) \
            .select("table_id", "key_pos", "col_idx", "col_name")
    listed = lake.key_list()
    declared = listed.join(cols.select("table_id", "col_idx", "col_name"), ["table_id", "col_idx"])
    fallback = (cols.join(listed.select("table_id").distinct(), "table_id", "left_anti")
                .select("table_id", F.col("col_idx").alias("key_pos"), "col_idx", "col_name"))
    return declared.select("table_id", "key_pos", "col_idx", "col_name").unionByName(fallback)


def valid_tables(lake: Lake, min_columns: int = 2) -> DataFrame:
    """Tables with at least ``min_columns`` columns and at least one
    column with cells (blank and null cells count: the list is not empty)."""
    filled = lake.cells.select("table_id").distinct().withColumn("has_cells", F.lit(True))
    t = lake.tables.join(filled, "table_id", "left")
    return t.select("table_id", "n_cols", (F.col("n_cols") >= min_columns) & F.coalesce("has_cells", F.lit(False))).toDF(
        "table_id", "n_cols", "valid")


def validity_counts(validity: DataFrame) -> DataFrame:
    """``(n_valid, n_skipped)`` of :func:`valid_tables`; one row, zeros for no table."""
    return validity.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_skipped"))


def positive_filter(pairs: DataFrame, lake: Lake) -> DataFrame:
    """label = 1 and both (table, column) exist."""
    cols = lake.columns.select("table_id", "col_name")
    return (pairs.where(F.col("label") == 1)
            .join(cols.select(F.col("table_id").alias("table1"), F.col("col_name").alias("column1")), ["table1", "column1"], "left_semi")
            .join(cols.select(F.col("table_id").alias("table2"), F.col("col_name").alias("column2")), ["table2", "column2"], "left_semi"))


def merge_lakes(first: Lake, second: Lake, winner: str = "second") -> Lake:
    """C14: union of two lakes by table id; ``winner`` = ``second`` (lake wins,
    A) or ``first`` (query wins, B).  Loser tables are removed with an anti
    join on the (small) table catalog."""
    win, lose = (second, first) if winner == "second" else (first, second)
    lose_ids = lose.tables.select("table_id").join(win.tables.select("table_id"), "table_id", "left_anti")
    keep = lambda df: df.join(lose_ids, "table_id", "left_semi")
    return Lake(win.tables.unionByName(keep(lose.tables)),
                win.columns.unionByName(keep(lose.columns)),
                win.cells.unionByName(keep(lose.cells)),
                win.key_list().unionByName(keep(lose.key_list())) if win.keys is not None or lose.keys is not None else None)
