"""Wide/long reshaping and unions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, ids: list[str], cols: list[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    """One row per (ids, column). NULL values keep their row."""
    return df.select(*ids, *cols).unpivot(ids, cols, name, value)


def to_wide(
    df: DataFrame,
    ids: str | list[str],
    names: Iterable[str],
    value: str,
    strict: bool = True,
    name: str = "variable",
) -> DataFrame:
    """One row per ``ids`` with a column per entry of ``names``, in that order.

    The names are given, so no job looks for them, and one partial + final
    aggregate over ``ids`` does the work. ``strict`` raises on a duplicate
    (ids, name) instead of keeping one of the two.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    names = list(names)
    at = {n: F.col(name) == n for n in names}
    aggregates = [F.max(F.when(at[n], F.col(value))).alias(n) for n in names]
    if not strict:
        return df.groupBy(*ids).agg(*aggregates)
    counts = [F.count_if(at[n]).alias(f"__n_{i}") for i, n in enumerate(names)]
    wide = df.groupBy(*ids).agg(*aggregates, *counts)
    twice = F.greatest(*[F.col(f"__n_{i}") for i in range(len(names))]) if len(names) > 1 else F.col("__n_0")
    message = F.concat(F.lit("duplicate rows for "), F.to_json(F.struct(*ids)))
    return wide.select(
        *ids, *[F.when(twice <= 1, F.col(n)).otherwise(F.raise_error(message)).alias(n) for n in names]
    )


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column that only one side has is NULL on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def union_same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name of tables with the same columns."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    return a.unionByName(b)
