"""Comparing a query with its DuckDB SQL over one data folder."""

import math

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") if abs(v) >= 1e6 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sql, d):
    import os

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            glob = f"{d}/{f}/*.parquet" if os.path.isdir(f"{d}/{f}") else f"{d}/{f}"
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{glob}')")
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
