"""Run registered queries on Spark and their SQL on DuckDB and compare the values."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    return v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, folder: str, name: str, run, sql: str | None, con=None) -> dict:
    t0 = time.time()
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - t0
    info = {"query": name, "rows": len(got), "sec": round(spark_time, 2), "status": "rows_only"}
    if sql is None:
        return info
    con = con or connect(folder)
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    info["sql_sec"] = round(time.time() - t0, 2)
    if sorted(df.columns) != sorted(cols):
        return {**info, "status": "COLUMNS", "detail": f"{sorted(df.columns)} vs {sorted(cols)}"}
    a, b = rows(df.columns, got), rows(cols, want)
    if len(a) != len(b):
        return {**info, "status": "ROWCOUNT", "detail": f"{len(a)} vs {len(b)}; {a[:2]} | {b[:2]}"}
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
    if bad:
        return {**info, "status": "VALUES", "detail": f"{len(bad)} differ, e.g. {bad[0][0]} vs {bad[0][1]}"}
    return {**info, "status": "match"}
