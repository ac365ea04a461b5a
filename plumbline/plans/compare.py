"""Run a registered query and its oracle and compare the rows as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from .registry import BASE_TABLES


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return type(v).__name__
    return type(v).__name__


def compare(df, sql: str, con) -> tuple[bool, str, int]:
    """Return (equal, explanation, rows)."""
    cols = sorted(df.columns)
    spark_rows = [tuple(r) for r in df.select(*[df[c] for c in cols]).collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    if sorted(ocols) != cols:
        return False, f"columns {cols} vs {sorted(ocols)}", len(spark_rows)
    order = [ocols.index(c) for c in cols]
    duck_rows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    a = Counter(tuple(_norm(v) for v in r) for r in spark_rows)
    b = Counter(tuple(_norm(v) for v in r) for r in duck_rows)
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"rows {len(spark_rows)} vs {len(duck_rows)}\n  spark-only {left}\n  oracle-only {right}", len(spark_rows)
    for i, c in enumerate(cols):
        ka = {_kind(r[i]) for r in spark_rows} - {None}
        kb = {_kind(r[i]) for r in duck_rows} - {None}
        if ka != kb:
            return False, f"column {c}: types {ka} vs {kb}", len(spark_rows)
    return True, "", len(spark_rows)
