"""Side-by-side check of a registered query against its reference SQL
(DuckDB, if installed).  Used by tests and while developing."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, sf_dir: str, con=None, show: int = 5) -> dict:
    from lakejoin.plans.registry import QUERIES, SQL
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = {"name": name, "spark_rows": len(s_rows)}
    if name not in SQL:
        res["oracle"] = None
        return res
    con = con or duck(sf_dir)
    cur = con.execute(SQL[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    res["match"] = res["cols_match"] and a == b
    if not res["match"]:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        res["only_spark"] = sorted(sa - sb)[:show]
        res["only_duck"] = sorted(sb - sa)[:show]
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
    return res
