"""Compares a query with its SQL in DuckDB, as multisets of rows."""

import math
import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(size):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{os.path.join(DATA, size, t)}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not hasattr(v, "hour") or (v.hour, v.minute, v.second) == (0, 0, 0) else v.isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else f
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(run, sql, spark, size="sf0.01"):
    got = run(spark, f"{DATA}/{size}")
    ex = connect(size).sql(sql)
    assert sorted(got.columns) == sorted(ex.columns)
    assert rows(got.columns, got.collect()) == rows(ex.columns, ex.fetchall())
