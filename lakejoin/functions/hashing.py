"""The built-in deterministic hash encoder, as expressions.

A token lands in dimension ``int(md5(token)[0:8], 16) mod D`` with sign taken
from the 9th hex digit.  The same two expressions are plain SQL in other
engines, so embeddings are reproducible outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 1024


def hash_dim(digest: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hash_sign(digest: Column) -> Column:
    return F.when(F.substring(digest, 9, 1) < F.lit("8"), F.lit(1)).otherwise(F.lit(-1))
