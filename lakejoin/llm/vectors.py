"""Vectors of whole numbers for the clustering and compression operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27      # components below this keep squared distances of 64 components within 64 bits


def valid(vec: str) -> Column:
    """The vector is there and holds neither nulls nor non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vec: str, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def check_range(df: DataFrame, vec: str = "v") -> None:
    """Raise if a component is too large for exact 64-bit distances."""
    most = df.agg(F.max(F.greatest(F.array_max(vec), -F.array_min(vec)))).first()[0]
    if most is not None and most >= LIMIT:
        raise ValueError(f"a component of {most} (limit {LIMIT}) would leave the range of exact 64-bit distances")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` components as int64."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(col), dim)
