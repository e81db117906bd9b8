"""lakejoin: joinable-table discovery over a data lake, as Spark DataFrame jobs.

Canonical relations (all plain DataFrames):

* ``lake_tables(table_id, table_pos, base_id, partition, n_cols, n_rows)``
* ``lake_columns(table_id, col_idx, col_name, description, key_pos)``
* ``lake_cells(table_id, row_idx, col_idx, col_name, value)``

Everything downstream (profiles, column text, embeddings, similarity joins,
rankings, metrics, training sets, clustering, losses) takes and returns
DataFrames; nothing whole is pulled through the driver.
"""

from lakejoin.lake import Lake
from lakejoin.session import get_spark, checkpoint_dir

__all__ = ["Lake", "get_spark", "checkpoint_dir"]
