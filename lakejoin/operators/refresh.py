"""Versioned centroids and assignments (H6).

A training run clusters once and again after every epoch; its losses read the
clusters in between.  Each refresh writes a whole new version next to the last
one and then a line in the manifest; readers take the last version that has a
line.  A refresh that stops half-way therefore changes nothing, and the next
one, which is handed the last complete version, starts from there.

The folder is ``root``; without one, a new folder below the shared checkpoint
folder.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.session import checkpoint_dir

CENTROIDS = "layer int, cluster_id int, vec array<double>"
ASSIGNMENTS = "layer int, sample_idx long, cluster_id int"


class ClusterStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}").rstrip("/")

    def version(self) -> tuple[int, str] | None:
        """(number, folder) of the last complete version."""
        try:
            row = (self.spark.read.schema("folder string, version int").parquet(f"{self.root}/manifest")
                   .orderBy(F.desc("version")).first())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return None if row is None else (row["version"], row["folder"])

    def refresh(self, clusters: Callable[[int | None], tuple[DataFrame, DataFrame] | list[DataFrame]]) -> int:
        """Write the next version: ``clusters`` is given the number of the last one
        (None at first) and returns (centroids, assignments), in either order;
        the one with ``vec`` are the centroids."""
        last = self.version()
        n = 1 if last is None else last[0] + 1
        folder = f"{n:06d}-{uuid.uuid4().hex}"
        for df in clusters(None if last is None else last[0]):
            name, schema = ("centroids", CENTROIDS) if "vec" in df.columns else ("assignments", ASSIGNMENTS)
            cols = [F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]
            df.select(*cols).write.parquet(f"{self.root}/{folder}/{name}")
        self.spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.parquet(f"{self.root}/manifest/version={n}")
        return n

    def _read(self, name: str, schema: str) -> DataFrame:
        last = self.version()
        if last is None:
            return self.spark.createDataFrame([], f"{schema}, version int")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{last[1]}/{name}").withColumn("version", F.lit(last[0]))

    def centroids(self) -> DataFrame:
        """``(layer, cluster_id, vec, version)``"""
        return self._read("centroids", CENTROIDS)

    def assignments(self) -> DataFrame:
        """``(layer, sample_idx, cluster_id, version)``"""
        return self._read("assignments", ASSIGNMENTS)
