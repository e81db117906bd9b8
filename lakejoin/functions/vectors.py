"""Dense vector expressions over ``array<float|double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COS_EPS = 1e-8      # added to each norm before dividing (cosine, J1)
NORM_EPS = 1e-12    # floor of the norm when unit-normalising (E5)


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """a/(|a|+eps) . b/(|b|+eps)."""
    return dot(a, b) / ((norm(a) + F.lit(COS_EPS)) * (norm(b) + F.lit(COS_EPS)))


def l2_normalize(a: Column, n: Column, eps: float = NORM_EPS) -> Column:
    """v / max(|v|, eps); pass the norm as an already computed column so it is
    not re-evaluated inside the lambda."""
    return F.transform(as_double(a), lambda x: x / F.greatest(n, F.lit(eps)))
