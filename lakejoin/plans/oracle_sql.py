"""Reference SQL (DuckDB dialect) for every registered query.

Each builder returns SQL over the raw driver tables (views ``region``,
``nation``, ... ``conversations``).  The fragments mirror the Spark operators
one to one: the same lake layout, the same hash encoder, the same ranking
tie-breaks, so results can be compared value by value.
"""

from __future__ import annotations

from lakejoin.functions.hashing import DEFAULT_DIM
from lakejoin.operators.profile import DEFAULT_BUDGET, VALUE_CUT
from lakejoin.sources.testdata import FRACTIONS, STAR_LINKS, STAR_SPEC


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ----------------------------------------------------------------- lakes

def row_id(row_expr: str) -> str:
    if row_expr.startswith("hash:"):
        body = ", ".join(f"CAST({c} AS VARCHAR)" for c in row_expr[5:].split(","))
        return f"('0x' || substr(md5(concat_ws('|', {body})), 1, 15))"
    return row_expr


def cell_text(c: str) -> str:
    return f"CAST({f'TRY_CAST({c} AS DECIMAL(38, 6))' if c in FRACTIONS else c} AS VARCHAR)"


def star_cells() -> str:
    parts = []
    for name, row_expr, cols, _ in STAR_SPEC:
        for i, c in enumerate(cols):
            parts.append(f"SELECT {q(name)} AS table_id, CAST({row_id(row_expr)} AS BIGINT) AS row_idx, {i} AS col_idx, "
                         f"{q(c)} AS col_name, {cell_text(c)} AS value FROM {name}")
    return "\nUNION ALL ".join(parts)


def star_columns() -> str:
    rows = []
    for name, _, cols, keys in STAR_SPEC:
        for i, c in enumerate(cols):
            kp = str(keys.index(c)) if c in keys else "NULL"
            rows.append(f"({q(name)}, {i}, {q(c)}, CAST(NULL AS VARCHAR), CAST({kp} AS INTEGER))")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(table_id, col_idx, col_name, description, key_pos)"


def star_tables() -> str:
    rows = [f"({q(n)}, {i})" for i, (n, *_) in enumerate(STAR_SPEC)]
    return ("SELECT table_id, table_id AS table_name, CAST(table_pos AS BIGINT) AS table_pos FROM (VALUES "
            + ", ".join(rows) + ") t(table_id, table_pos)")


def star_truth() -> str:
    return (f"WITH held AS ({star_links_ordered()}) "
            "SELECT query_id, cand_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cand_id) - 1 AS INTEGER) AS pos "
            "FROM (SELECT table1 AS query_id, table2 AS cand_id FROM held UNION SELECT table2, table1 FROM held)")


def star_truth_queries() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(n)})" for n, *_ in STAR_SPEC) + ") t(query_id)"


def star_links() -> str:
    return "SELECT table1, column1, table2, column2 FROM (" + star_links_ordered() + ")"


def star_links_ordered() -> str:
    return "\nUNION ALL ".join(
        f"SELECT {i} AS link_pos, {q(a)} AS table1, {q(b)} AS column1, {q(c)} AS table2, {q(d)} AS column2 "
        f"WHERE (SELECT count({b}) FROM {a}) > 0 AND (SELECT count(*) FROM (SELECT DISTINCT {b} AS v FROM {a} "
        f"WHERE {b} IS NOT NULL) x ANTI JOIN (SELECT {d} AS v FROM {c}) y ON x.v = y.v) = 0"
        for i, (a, b, c, d) in enumerate(STAR_LINKS))


def grouped_cells(table: str, prefix: str, group_col: str, row_col: str, cols: list[str]) -> str:
    parts = [f"SELECT {q(prefix)} || CAST({group_col} AS VARCHAR) AS table_id, CAST({row_col} AS BIGINT) AS row_idx, "
             f"{i} AS col_idx, {q(c)} AS col_name, CAST({c} AS VARCHAR) AS value FROM {table}"
             for i, c in enumerate(cols)]
    return "\nUNION ALL ".join(parts)


def grouped_columns(table: str, prefix: str, group_col: str, cols: list[str], keys: list[int]) -> str:
    from lakejoin.sources.testdata import DESCRIPTIONS
    vals = ", ".join(f"({i}, {q(c)}, {str(keys.index(i)) if i in keys else 'NULL'}, "
                     f"{q(DESCRIPTIONS[c]) if c in DESCRIPTIONS else 'NULL'})" for i, c in enumerate(cols))
    return (f"SELECT DISTINCT {q(prefix)} || CAST({group_col} AS VARCHAR) AS table_id, s.col_idx, s.col_name, "
            f"CAST(s.description AS VARCHAR) AS description, CAST(s.key_pos AS INTEGER) AS key_pos "
            f"FROM {table}, (VALUES {vals}) s(col_idx, col_name, key_pos, description)")


def grouped_tables(table: str, prefix: str, group_col: str) -> str:
    return (f"SELECT DISTINCT {q(prefix)} || CAST({group_col} AS VARCHAR) AS table_id, "
            f"{q(prefix)} || CAST({group_col} AS VARCHAR) AS table_name, CAST({group_col} AS BIGINT) AS table_pos "
            f"FROM {table}")


EVENTS = ("events", "user-", "user_id", "event_id", ["event_type", "props"], [0, 1])
CONVS = ("conversations", "conv_", "conv_id", "turn", ["role", "text"], [0, 1])


def lake_ctes(kind: str) -> str:
    """``cells``, ``columns``, ``tables`` CTEs of a named lake."""
    if kind == "star":
        return f"cells AS ({star_cells()}),\ncolumns AS ({star_columns()}),\ntables AS ({star_tables()})"
    t, p, g, r, cols, keys = EVENTS if kind == "events" else CONVS
    return (f"cells AS ({grouped_cells(t, p, g, r, cols)}),\ncolumns AS ({grouped_columns(t, p, g, cols, keys)}),\n"
            f"tables AS ({grouped_tables(t, p, g)})")


# ----------------------------------------------------------------- text

WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def words(x: str) -> str:
    return WORDS.format(x=x)


def fmt_1f(x: str) -> str:
    return f"printf('%.1f', {x})"


def column_text_ctes(cells: str = "cells", columns: str = "columns", tables: str = "tables",
                     pattern: str = "title-colname-stat-col", lake_freq: str | None = None,
                     budget: int = DEFAULT_BUDGET, prefix: str = "") -> str:
    """CTEs ``{prefix}groups ... {prefix}coltext(table_id, col_name, text)``."""
    p = prefix
    order_freq = "v.freq" if lake_freq is None else "coalesce(lf.freq, 0)"
    lf_join = "" if lake_freq is None else f"LEFT JOIN {lake_freq} lf ON lf.value = v.value"
    stat = (f"c.col_name || ' contains ' || CAST(coalesce(pr.n_distinct, 0) AS VARCHAR) || ' values (' || "
            f"CAST(coalesce(pr.max_len, 0) AS VARCHAR) || ', ' || CAST(coalesce(pr.min_len, 0) AS VARCHAR) || ', ' || "
            f"{fmt_1f('coalesce(pr.avg_len, 0.0)')} || '): ' || coalesce(sv.values_text, '')")
    v = "coalesce(sv.values_text, '')"
    text = {
        "col": v,
        "colname-col": f"c.col_name || ': ' || {v}",
        "colname-stat-col": stat,
        "title-colname-stat-col": stat,
        "title-colname-col": f"coalesce(c.table_name, c.table_id) || '. ' || c.col_name || ': ' || {v}",
    }.get(pattern, f"c.table_id || '. ' || {stat}")
    return f"""
{p}groups AS (
  SELECT table_id, col_name, value, count(*) AS freq, min(row_idx) AS first_row
  FROM {cells} GROUP BY table_id, col_name, value),
{p}profile AS (
  SELECT table_id, col_name, count(*) AS n_distinct,
         coalesce(max(length(value)), 0) AS max_len, coalesce(min(length(value)), 0) AS min_len,
         coalesce(sum(length(value) * freq) / sum(CASE WHEN value IS NOT NULL THEN freq END), 0.0) AS avg_len
  FROM {p}groups GROUP BY table_id, col_name),
{p}ranked AS (
  SELECT v.table_id, v.col_name, v.value,
         row_number() OVER (PARTITION BY v.table_id, v.col_name ORDER BY {order_freq} DESC, v.first_row ASC) AS rn
  FROM {p}groups v {lf_join} WHERE v.value IS NOT NULL),
{p}costed AS (
  SELECT table_id, col_name, rn, substring(value, 1, {VALUE_CUT}) AS cut,
         len({words(f"substring(value, 1, {VALUE_CUT})")}) AS ntok
  FROM {p}ranked WHERE rn <= {budget + 1}),
{p}cum AS (
  SELECT *, ntok + CASE WHEN rn > 1 THEN 1 ELSE 0 END AS cost,
         sum(ntok + CASE WHEN rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, col_name ORDER BY rn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumcost
  FROM {p}costed),
{p}sample AS (
  SELECT table_id, col_name, rn,
         CASE WHEN rn = 1 AND ntok > {budget} THEN substring(cut, 1, {2 * budget}) ELSE cut END AS value
  FROM {p}cum WHERE cumcost <= {budget} OR (rn = 1 AND ntok > {budget})),
{p}svals AS (
  SELECT table_id, col_name, string_agg(value, ', ' ORDER BY rn) AS values_text
  FROM {p}sample GROUP BY table_id, col_name),
{p}coltext AS (
  SELECT c.table_id, c.col_name, {text} AS text
  FROM (SELECT DISTINCT cc.table_id, cc.col_name, t.table_name FROM {columns} cc
        LEFT JOIN {tables} t ON t.table_id = cc.table_id) c
  LEFT JOIN {p}profile pr ON pr.table_id = c.table_id AND pr.col_name = c.col_name
  LEFT JOIN {p}svals sv ON sv.table_id = c.table_id AND sv.col_name = c.col_name)"""


def hash_ctes(src: str, ids: list[str], text: str, dim: int = DEFAULT_DIM, name: str = "emb",
              mode: str = "words", offset: str | None = None) -> str:
    """Sparse hash encoding ``{name}(ids..., dim, w)`` and ``{name}_norm(ids..., norm)``."""
    idl = ", ".join(ids)
    keep = idl + (f", {offset}" if offset else "")
    tok = f"unnest({words(text)})" if mode == "words" else text
    dimexpr = f"CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) % {dim}"
    if offset:
        dimexpr = f"{dimexpr} + {offset} * {dim}"
    return f"""
{name}_tok AS (SELECT {keep}, {tok} AS token FROM {src}{' WHERE ' + text + ' IS NOT NULL' if mode != 'words' else ''}),
{name}_tf AS (SELECT {keep}, token, count(*) AS tf, md5(token) AS digest FROM {name}_tok GROUP BY ALL),
{name} AS (
  SELECT {idl}, CAST({dimexpr} AS INTEGER) AS dim,
         CAST(sum(CASE WHEN substr(digest, 9, 1) < '8' THEN 1 ELSE -1 END * tf) AS BIGINT) AS w
  FROM {name}_tf GROUP BY ALL HAVING sum(CASE WHEN substr(digest, 9, 1) < '8' THEN 1 ELSE -1 END * tf) <> 0),
{name}_norm AS (SELECT {idl}, sqrt(CAST(sum(w * w) AS DOUBLE)) AS norm FROM {name} GROUP BY ALL)"""


def cosine_cte(name: str, left: str, right: str, ids: list[str], lp: str, rp: str, cond: str = "TRUE") -> str:
    """``{name}(lp ids, rp ids, dot, sim)`` from two sparse embeddings."""
    lsel = ", ".join(f"a.{c} AS {lp}{c}" for c in ids)
    rsel = ", ".join(f"b.{c} AS {rp}{c}" for c in ids)
    lon = " AND ".join(f"ln.{c} = d.{lp}{c}" for c in ids)
    ron = " AND ".join(f"rn.{c} = d.{rp}{c}" for c in ids)
    cols = ", ".join([f"d.{lp}{c}" for c in ids] + [f"d.{rp}{c}" for c in ids])
    return f"""
{name}_dot AS (
  SELECT {lsel}, {rsel}, CAST(sum(a.w * b.w) AS DOUBLE) AS dot
  FROM {left} a JOIN {right} b ON a.dim = b.dim WHERE {cond.format(a='a', b='b')} GROUP BY ALL),
{name} AS (
  SELECT {cols}, d.dot, d.dot / ((ln.norm + 1e-8) * (rn.norm + 1e-8)) AS sim
  FROM {name}_dot d JOIN {left}_norm ln ON {lon} JOIN {right}_norm rn ON {ron})"""
