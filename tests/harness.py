"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, f, sql, con=None):
    """None if equal, else what differs."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = (con or connect(sf_dir)).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} / {len(want)}; only Spark {sorted(a)[:2]}; only SQL {sorted(b)[:2]}"
    return None
