"""Run one query on Spark and its SQL on DuckDB and compare whole results."""
import datetime as dt
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return f"{_kind(v)}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if df.columns else "no columns", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    if a != b:
        i = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        names = sorted(cols)
        return f"row {i}: " + "; ".join(f"{n}: {x} != {y}" for n, x, y in zip(names, a[i], b[i]) if x != y), len(got)
    return None, len(got)
