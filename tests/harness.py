"""Runs a registered query and its SQL counterpart and compares them as multisets of rows."""

from __future__ import annotations

import math

import duckdb

from leadquarry.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in data], key=repr)


def compare(spark_df, con, sql):
    """Returns (ok, message)."""
    cols = spark_df.columns
    got = rows(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    sql_cols = [d[0] for d in cur.description]
    want = rows(sql_cols, cur.fetchall())
    if sorted(cols) != sorted(sql_cols):
        return False, f"columns {sorted(cols)} != {sorted(sql_cols)}"
    have = {c: t for c, t in spark_df.dtypes}
    diff = {d[0]: (have[d[0]], str(d[1])) for d in cur.description if SQL_TYPES.get(str(d[1])) != have[d[0]]}
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; spark only {a}; sql only {b}"
    if diff:
        return False, f"types {diff}"
    return True, f"{len(got)} rows"
