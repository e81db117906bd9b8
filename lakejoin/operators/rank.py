"""Top-K and full rankings.

``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before the
shuffle, so each task ships at most k rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, part: list[str], order: list[Column], k: int | None = None,
                name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w).cast("long"))
    if k is not None:
        out = out.where(F.col(name) <= k)
    return out
