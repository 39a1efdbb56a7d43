"""Run a query and its SQL, compare rows as sets with counts."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def differences(spark_df, con, sql: str, show: int = 3) -> str:
    """Empty when columns, row counts and values agree."""
    left, left_cols = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right, right_cols = table(names, cursor.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if left == right:
        return ""
    extra, lacking = left - right, right - left
    return (
        f"rows {sum(left.values())} vs {sum(right.values())}; "
        f"only spark ({sum(extra.values())}): {list(extra)[:show]}; "
        f"only sql ({sum(lacking.values())}): {list(lacking)[:show]}"
    )
