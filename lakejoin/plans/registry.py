"""Registered queries: name -> (spark builder, reference SQL builder).

Every query reads the driver's tables (or lakes Spark derives from them) in
full.  Doubles are rounded to 6 decimals at the output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.plans import oracle_sql as O
from lakejoin.sources import testdata as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# Import query modules so they register themselves.
from lakejoin.plans import queries_text  # noqa: E402,F401
from lakejoin.plans import queries_eval  # noqa: E402,F401
from lakejoin.plans import queries_rows  # noqa: E402,F401
from lakejoin.plans import queries_catalog  # noqa: E402,F401
from lakejoin.plans import queries_pairs  # noqa: E402,F401
from lakejoin.plans import queries_cluster  # noqa: E402,F401
from lakejoin.plans import queries_sinks  # noqa: E402,F401
from lakejoin.plans import queries_encoder  # noqa: E402,F401
