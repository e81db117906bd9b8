"""A store of column embeddings that several searches share.

The rows lie in a bucketed table, by table id and sorted by column, so norms,
look-ups and joins per table read it without an exchange.  What a table's
embeddings were made of is kept as a fingerprint of its cells and columns (a
count and two order-free sums of row hashes, one aggregate over the lake); only
tables whose fingerprint is new or has changed are encoded again.

Each refresh that changes something writes one ``batch`` of rows and then a new
manifest, which names for every table of the lake the batch that holds it.  The
manifest is written last: a refresh that stops half-way leaves rows that no
manifest names, and the next one starts from the last manifest.  Tables that
left the lake are in the next manifest no more.  One writer at a time.

The folder is ``root``; without one, a folder below ``spark.checkpoint.dir``,
shared by all executors and living as long as the application.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.lake import Lake
from lakejoin.session import checkpoint_dir, cut_lineage

BUCKETS = 16
SORT = ["table_id", "col_name"]


def fingerprints(lake: Lake, names: bool = False) -> DataFrame:
    """``(table_id, fp)`` of every table with columns: changes with any cell or
    column of the table, with ``names`` also with its name, not with the order of
    its rows.  The catalog's row counts are not needed, so not computed."""
    def sums(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        h = lambda seed: F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")
        return df.groupBy("table_id").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.sum(h(1)).cast("string"),
                                                      F.sum(h(2)).cast("string")).alias(name))

    cells = sums(lake.cells, ["row_idx", "col_idx", "col_name", "value"], "c")
    columns = sums(lake.columns, ["col_idx", "col_name", "description"], "k")
    both = columns.join(cells, "table_id", "left")
    if names:
        both = both.join(lake.tables.select("table_id", "table_name"), "table_id", "left")
    name = F.coalesce("table_name", F.lit("")) if names else F.lit("")
    return both.select("table_id", F.md5(F.concat_ws("|", name, F.coalesce("c", F.lit("")), "k")).alias("fp"))


def part_of(lake: Lake, ids: DataFrame) -> Lake:
    keep = lambda df: df.join(ids, "table_id", "left_semi")
    return Lake(keep(lake.tables), keep(lake.columns), keep(lake.cells), keep(lake.keys) if lake.keys is not None else None)


class EmbeddingStore:
    """``name`` stands for what was encoded and how (lake, encoder, text pattern)."""

    def __init__(self, spark: SparkSession, name: str, schema: str = "table_id string, col_name string, dim int, w long, norm double",
                 root: str | None = None, buckets: int = BUCKETS):
        self.spark, self.schema, self.buckets = spark, schema, buckets
        digest = hashlib.md5(name.encode()).hexdigest()[:16]
        self.root = (root or f"{checkpoint_dir(spark)}/stores").rstrip("/") + f"/{digest}"
        self.table = f"embedding_store_{hashlib.md5(self.root.encode()).hexdigest()[:16]}"

    def manifest(self) -> DataFrame | None:
        """``(table_id, fp, batch)`` of the last complete refresh."""
        try:
            all_ = self.spark.read.schema("table_id string, fp string, batch string, version int").parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = all_.agg(F.max("version")).first()[0]
        return None if last is None else all_.where(F.col("version") == last).select("table_id", "fp", "batch", "version")

    def _registered(self, filled: bool) -> None:
        """The bucketed table over the folder, known to this session's catalog
        with the batches that are there."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE {self.table} ({self.schema}, batch string) USING parquet PARTITIONED BY (batch) "
                           f"CLUSTERED BY (table_id) SORTED BY ({', '.join(SORT)}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/data'")
            if filled:
                self.spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def refresh(self, lake: Lake, encode: Callable[[Lake], DataFrame], names: bool = False) -> int:
        """Bring the store up to the lake; returns how many tables were encoded.
        ``encode`` gives rows of the store's schema for the lake it is handed;
        ``names``: they depend on the tables' names."""
        now = cut_lineage(fingerprints(lake, names))
        have = self.manifest()
        if have is None:
            changed, kept, version = now, None, 1
        else:
            same = ["table_id", "fp"]
            changed, kept = now.join(have, same, "left_anti"), have.join(now, same, "left_semi").select("table_id", "fp", "batch")
            version = have.agg(F.max("version")).first()[0]
            version = 1 if version is None else version + 1
        changed = cut_lineage(changed)
        n = changed.count()
        if have is not None and n == 0 and kept.count() == have.count():
            return 0
        batch = f"{version:06d}-{uuid.uuid4().hex}"
        if n:
            rows = encode(lake if kept is None else part_of(lake, changed.select("table_id")))
            cols = [c.split()[0] for c in self.schema.split(",")]
            self._registered(have is not None)
            rows.select(*cols, F.lit(batch).alias("batch")).repartition(self.buckets, "table_id").write.insertInto(self.table)
        new = changed.select("table_id", "fp", F.lit(batch).alias("batch"))
        (new if kept is None else new.unionByName(kept)).write.parquet(f"{self.root}/manifest/version={version}")
        return n

    def rows(self) -> DataFrame:
        """The current embeddings, partitioned by table id as the table is."""
        have = self.manifest()
        if have is None:
            return self.spark.createDataFrame([], self.schema)
        self._registered(True)
        batches = [r[0] for r in have.select("batch").distinct().collect()]      # one a refresh
        named = have.select("table_id", F.col("batch").alias("named"))
        data = self.spark.table(self.table).where(F.col("batch").isin(batches))
        # not an equality of two columns: that would become a join key, and the buckets would no longer fit
        return data.join(named, "table_id").where(F.array_contains(F.array("named"), F.col("batch"))).drop("batch", "named")
