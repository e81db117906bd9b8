"""The streamed search returns what the batch search returns."""

from pyspark.sql import functions as F

from lakejoin.operators.similarity import table_search_columns
from lakejoin.plans.flows import lake_column_embeddings
from lakejoin.sources.json_tables import read_table_documents, write_table_documents
from lakejoin.sources.testdata import star_lake
from lakejoin.streaming import search_stream, write_lake_embeddings

from lake_paths import SF001


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    lake = star_lake(spark, SF001)
    emb_path = str(tmp_path / "emb")
    write_lake_embeddings(lake, emb_path)
    qdir = tmp_path / "queries"
    write_table_documents(lake, str(qdir), n_files=3)
    out = str(tmp_path / "out")
    q = search_stream(spark, str(qdir), emb_path, out, str(tmp_path / "ckpt"), k=5)
    q.awaitTermination(300)
    got = sorted((r.query_id, r.cand_id, r.rank) for r in spark.read.parquet(out).collect())
    query = read_table_documents(spark, str(qdir))
    batch = table_search_columns(lake_column_embeddings(query, keys_only=True), spark.read.parquet(emb_path),
                                 query.key_columns().select("table_id", "col_name"), 5)
    exp = sorted((r.query_id, r.cand_id, r.rank) for r in batch.collect())
    assert got == exp and len(got) > 0
    _ = F
