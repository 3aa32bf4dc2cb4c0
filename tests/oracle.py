"""Holds a query against its DuckDB form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 8) if math.isfinite(v) else repr(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, order, data):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    assert rows(df.columns, order, df.collect()) == rows(names, order, cur.fetchall())
