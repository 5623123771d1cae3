"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate)."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

from punctual.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (int,)):
        return float(v) if not isinstance(v, bool) else int(v)
    return str(v)


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, con, sql: str) -> dict:
    sp = spark_df.toPandas()
    dk = con.execute(sql).df()
    out = {"spark_rows": len(sp), "oracle_rows": len(dk),
           "spark_cols": sorted(sp.columns), "oracle_cols": sorted(dk.columns)}
    out["schema_match"] = out["spark_cols"] == out["oracle_cols"]
    out["rows_match"] = len(sp) == len(dk)
    if out["schema_match"] and out["rows_match"]:
        a, b = frame_rows(sp), frame_rows(dk)
        out["values_match"] = a == b
        if not out["values_match"]:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            out["first_diffs"] = diffs
        out["hash"] = hashlib.md5(repr(a).encode()).hexdigest()
    else:
        out["values_match"] = False
    return out
