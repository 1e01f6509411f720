"""Run registered queries in Spark and their SQL oracles in DuckDB, and compare
results order-insensitively (columns by name, doubles rounded)."""

from __future__ import annotations

import math
import time

import duckdb
import numpy as np
import pandas as pd

from rolloutlab.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v, digits: int):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) + 0.0
    if isinstance(v, np.generic):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x, digits) for x in (v.tolist() if isinstance(v, np.ndarray) else v))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def rows_of(df: pd.DataFrame, digits: int) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c], digits) for c in cols) for _, r in df[cols].iterrows()]
    return sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str, digits: int = 6) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    rows = [r.asDict(recursive=True) for r in sdf.collect()]
    spd = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in sdf.columns})
    t1 = time.time()
    res = {"query": name, "spark_rows": len(spd), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    cols, data = rel.columns, rel.fetchall()
    odf = pd.DataFrame({c: pd.Series([r[i] for r in data], dtype=object) for i, c in enumerate(cols)})
    res["oracle_rows"] = len(odf)
    if sorted(spd.columns) != sorted(odf.columns):
        res["status"] = f"COLUMNS spark={sorted(spd.columns)} oracle={sorted(odf.columns)}"
        return res
    a, b = rows_of(spd, digits), rows_of(odf, digits)
    if a == b:
        res["status"] = "match"
    else:
        diff = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else a[:1]
        other = [x for x in b if x not in set(a)][:2] if len(b) < 20000 else b[:1]
        res["status"] = "MISMATCH"
        res["example_spark"] = repr(diff)[:600]
        res["example_oracle"] = repr(other)[:600]
    return res
