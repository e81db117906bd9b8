"""The canonical lake: three long relations instead of thousands of wide tables.

``tables``  : table_id, table_name, table_pos, base_id, partition, n_cols, n_rows
``columns`` : table_id, col_idx, col_name, description, key_pos
``cells``   : table_id, row_idx, col_idx, col_name, value

``key_pos`` is the position of the column in the table's join-key list, counting
each column once (NULL when the column is not a key).  ``keys``, if a source gives
it, is that list as it stands, repeats included: table_id, key_pos, col_idx.  ``value`` is text (NULL for a missing cell).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.functions.catalog import infer_base_id, infer_partition

TABLE_COLS = ["table_id", "table_name", "table_pos", "base_id", "partition", "n_cols", "n_rows"]
COLUMN_COLS = ["table_id", "col_idx", "col_name", "description", "key_pos"]
CELL_COLS = ["table_id", "row_idx", "col_idx", "col_name", "value"]


@dataclass
class Lake:
    tables: DataFrame
    columns: DataFrame
    cells: DataFrame
    keys: DataFrame | None = None

    def key_list(self) -> DataFrame:
        """(table_id, key_pos, col_idx): the declared join keys in their order, repeats included."""
        if self.keys is not None:
            return self.keys.select("table_id", "key_pos", "col_idx")
        return self.key_columns().select("table_id", "key_pos", "col_idx")

    def key_columns(self) -> DataFrame:
        """(table_id, key_pos, col_idx, col_name) of the declared join keys."""
        return (self.columns.where(F.col("key_pos").isNotNull())
                .select("table_id", "key_pos", "col_idx", "col_name"))

    def key_cells(self) -> DataFrame:
        """Cells of key columns only (semi join on the small column catalog)."""
        keys = self.key_columns().select("table_id", "col_idx")
        return self.cells.join(keys, ["table_id", "col_idx"], "left_semi")

    def persist(self) -> "Lake":
        return Lake(self.tables.cache(), self.columns.cache(), self.cells.cache(), self.keys.cache() if self.keys is not None else None)


def tables_from_parts(columns: DataFrame, cells: DataFrame, positions: DataFrame,
                      explicit_base: str | None = None) -> DataFrame:
    """Build ``lake_tables`` from the column catalog, the cells and a
    (table_id, table_pos[, base_id, partition]) relation (C1-C3)."""
    n_cols = columns.groupBy("table_id").agg(F.count(F.lit(1)).cast("int").alias("n_cols"))
    n_rows = cells.groupBy("table_id").agg(F.countDistinct("row_idx").alias("n_rows"))
    base = positions
    for c in ("base_id", "partition"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    if "table_name" not in base.columns:
        base = base.withColumn("table_name", F.col("table_id"))
    out = (base.join(n_cols, "table_id", "left").join(n_rows, "table_id", "left")
           .select(
               "table_id", "table_name", F.col("table_pos").cast("long").alias("table_pos"),
               F.coalesce(F.nullif(F.col("base_id"), F.lit("")), infer_base_id(F.col("table_id"))).alias("base_id"),
               F.coalesce(F.nullif(F.col("partition"), F.lit("")), infer_partition(F.col("table_id"))).alias("partition"),
               F.coalesce("n_cols", F.lit(0)).cast("int").alias("n_cols"),
               F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")))
    return out
