"""Compare a Spark query result with its DuckDB oracle (rows, columns, values)."""

from __future__ import annotations

import collections
import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    if isinstance(v, dict):
        return _norm(tuple(v.values()))
    return repr(v)


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.sql(sql)
    d_cols = list(res.columns)
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duck={len(d_rows)}"
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_ms = collections.Counter(tuple(_norm(r[i]) for i in order) for r in s_rows)
    d_ms = collections.Counter(tuple(_norm(r[d_index[s_cols[i]]]) for i in order) for r in d_rows)
    if s_ms != d_ms:
        only_s = list((s_ms - d_ms).elements())[:3]
        only_d = list((d_ms - s_ms).elements())[:3]
        return False, f"values differ ({[s_cols[i] for i in order]}): spark-only={only_s} duck-only={only_d}"
    return True, f"{len(s_rows)} rows"
