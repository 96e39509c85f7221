"""Runs a query and its SQL twin and compares columns and sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (2, f"{float(v):.9g}".replace("-0", "0") if float(v) == 0 else f"{float(v):.9g}")
    return (3, str(v))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, f, sql: str) -> str:
    """Empty where both agree, else what differs."""
    df = f(spark, sf_dir)
    a, x = normal(df.columns, [tuple(r) for r in df.collect()])
    b, y = normal(*run_sql(sf_dir, sql))
    if a != b:
        return f"columns {a} {b}"
    if len(x) != len(y):
        return f"rows {len(x)} {len(y)}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} differ: {bad[0]}" if bad else ""
