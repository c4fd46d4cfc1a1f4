"""Spark query vs DuckDB oracle: row count, column names, type family and
order-insensitive values (the same checks the driver's gate makes)."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family_spark(t: str) -> str:
    t = t.lower()
    if t in ("int", "integer"):
        return "int"
    if t in ("bigint", "long"):
        return "bigint"
    if t in ("double", "float"):
        return "double"
    if t.startswith("timestamp"):
        return "timestamp"
    return {"string": "string", "date": "date", "boolean": "boolean"}.get(t, t)


def _family_duck(t: str) -> str:
    t = t.upper()
    if t == "INTEGER":
        return "int"
    if t == "BIGINT":
        return "bigint"
    if t in ("DOUBLE", "FLOAT"):
        return "double"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    return {"VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}.get(t, t.lower())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found (empty list = match)."""
    problems = []
    s_cols = [(f.name, _family_spark(f.dataType.simpleString())) for f in spark_df.schema.fields]
    rel = con.sql(sql)
    d_cols = [(n, _family_duck(str(t))) for n, t in zip(rel.columns, rel.types)]
    if sorted(c for c, _ in s_cols) != sorted(c for c, _ in d_cols):
        problems.append(f"columns differ: spark={sorted(c for c, _ in s_cols)} duck={sorted(c for c, _ in d_cols)}")
        return problems
    sd, dd = dict(s_cols), dict(d_cols)
    for c in sd:
        if sd[c] != dd[c]:
            problems.append(f"type of {c}: spark={sd[c]} duck={dd[c]}")
    order = sorted(sd)
    s_rows = [tuple(_norm(r[c]) for c in order) for r in spark_df.collect()]
    d_idx = [rel.columns.index(c) for c in order]
    d_rows = [tuple(_norm(r[i]) for i in d_idx) for r in rel.fetchall()]
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    if s_sorted != d_sorted:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
        problems.append(f"values differ (first: {diff})")
    return problems
