"""Compare a Spark result with a DuckDB oracle query on the same parquet
tables (development and test helper; the driver runs its own compare)."""

from __future__ import annotations

import glob
import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark_df, sql: str, sf_dir: str, con=None):
    """Return (ok, message).  Rows compared as sorted multisets, columns by name."""
    con = con or duckdb_conn(sf_dir)
    rel = con.sql(sql)
    o_cols = rel.columns
    o_rows = rel.fetchall()
    s_cols = spark_df.columns
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns differ: spark={s_cols} oracle={o_cols}"
    order = sorted(s_cols)
    s_idx = [s_cols.index(c) for c in order]
    o_idx = [o_cols.index(c) for c in order]
    s_rows = spark_df.collect()
    sr = sorted((tuple(_norm(r[i]) for i in s_idx) for r in s_rows), key=repr)
    orr = sorted((tuple(_norm(r[i]) for i in o_idx) for r in o_rows), key=repr)
    if len(sr) != len(orr):
        return False, f"row count differs: spark={len(sr)} oracle={len(orr)}"
    for a, b in zip(sr, orr):
        if a != b:
            return False, f"first difference: spark={a} oracle={b}"
    return True, f"{len(sr)} rows equal"
