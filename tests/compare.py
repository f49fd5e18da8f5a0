"""Compare a Spark query with its oracle SQL on DuckDB, the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(sf_dir).iterdir():
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{glob}'")
    return con.sql(sql)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def check(spark, name, query, sf_dir, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = oracle(sf_dir, sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (name, df.columns, rel.columns)
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (name, a, b)
    return len(got)
