"""Runs queries against DuckDB SQL on the same tables."""

import math
import os
from collections import Counter

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, (list, dict)):
        return str(v)
    return str(v) if hasattr(v, "isoformat") else v


def differences(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    a = Counter(tuple(map(norm, r)) for r in df.select(cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    ix = [names.index(c) for c in cols]
    b = Counter(tuple(norm(r[i]) for i in ix) for r in cur.fetchall())
    return (a - b), (b - a)
