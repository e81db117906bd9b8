"""Incremental table search (F1 served as a stream).

The lake side is embedded once (E2 over key columns) and written as parquet
in the shared folder.  A file stream of query documents then runs the same
key-column search (J3 -> A4 -> A5 -> W4) per micro-batch inside
``foreachBatch``; results are appended with the batch id, so a restarted
query resumes from its checkpoint without duplicating finished batches
(idempotent per batch id: each batch overwrites its own partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.functions.hashing import DEFAULT_DIM
from lakejoin.lake import Lake
from lakejoin.plans.flows import DEFAULT_K, lake_column_embeddings
from lakejoin.operators.similarity import table_search_columns
from lakejoin.sources.json_tables import documents_from_text, lake_from_documents


def write_lake_embeddings(lake: Lake, path: str, dim: int = DEFAULT_DIM) -> None:
    lake_column_embeddings(lake, dim, keys_only=True).write.mode("overwrite").parquet(path)


def search_stream(spark: SparkSession, query_dir: str, lake_emb_path: str, out_path: str,
                  checkpoint: str, k: int = DEFAULT_K, dim: int = DEFAULT_DIM, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    lake_emb = spark.read.parquet(lake_emb_path)
    stream = (spark.readStream.format("text").option("wholetext", True).load(query_dir)
              .select(F.col("_metadata.file_path").alias("file"), "value"))

    def run(batch: DataFrame, batch_id: int) -> None:
        query = lake_from_documents(documents_from_text(batch, on_error="skip"), "row_major", "last")
        q_emb = lake_column_embeddings(query, dim, keys_only=True)
        q_keys = query.key_columns().select("table_id", "col_name")
        preds = table_search_columns(q_emb, lake_emb, q_keys, k).withColumn("batch_id", F.lit(batch_id))
        (preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
