"""Column selection, typing, splits, small ordered reads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.operators.ordered import add_row_id


def cols_starting(df: DataFrame, prefix: str) -> list[str]:
    """Names that start with ``prefix``, ignoring case."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def cols_containing(df: DataFrame, part: str) -> list[str]:
    """Names that contain ``part``, ignoring case."""
    return [c for c in df.columns if part.lower() in c.lower()]


def cols_except(names: Iterable[str], drop: Iterable[str]) -> list[str]:
    gone = set(drop)
    return [n for n in names if n not in gone]


def order_and_suffix(df: DataFrame, key: str, names: Iterable[str], suffix: str) -> DataFrame:
    """``key`` first, then ``names`` in the given order with ``suffix`` added."""
    return df.select(key, *[F.col(n).alias(n + suffix) for n in names])


def to_double(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def index_label(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Number the levels of ``col`` 0, 1, ... in sorted order; NULL stays NULL.

    The levels are numbered as a table, so they may be as many as the rows.
    """
    levels = add_row_id(df.select(col).filter(F.col(col).isNotNull()).distinct(), col, "__n")
    numbers = levels.select(col, (F.col("__n") - 1).cast("double").alias(out))
    return df.join(numbers, col, "left").select(*df.columns, out)


def assemble(df: DataFrame, cols: list[str], out: str = "features", invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=invalid).transform(df)


def split_by_flag(df: DataFrame, flag: str = "validation") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with flag 0, rows with flag 1, all rows); a row with another or a NULL flag is in the last only."""
    return df.filter(F.col(flag) == 0), df.filter(F.col(flag) == 1), df


def leaderboard(results: DataFrame, metric: str, top: int | None = None, tie: str = "model_id") -> DataFrame:
    """Best metric first; ``tie`` makes the order total."""
    ordered = results.orderBy(F.desc(metric), F.asc(tie))
    return ordered if top is None else ordered.limit(top)


def first_rows(df: DataFrame, order_by: str | list[str], n: int = 6) -> DataFrame:
    return df.orderBy(order_by).limit(n)
