"""Key joins between feature, statistic and prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscore.operators.ordered import add_row_id


def join_features(keys: DataFrame, feats: DataFrame, key: str = "id") -> DataFrame:
    return keys.join(feats, key)


def join_blocks(dfs: list[DataFrame], key: str = "id") -> DataFrame:
    """Inner join of feature blocks that share ``key``."""
    return reduce(lambda a, b: a.join(b, key), dfs)


def lookup_stats(long: DataFrame, stats: DataFrame, on: str = "variable") -> DataFrame:
    """Left join of a long table to statistics of its groups.

    Statistics by ``variable`` have one row for each column of a wide table and are
    sent to every task; those of other groups may be as many as the rows and are joined as they come.
    """
    return long.join(F.broadcast(stats) if on == "variable" else stats, on, "left")


def join_anchor(long: DataFrame, anchor: str, key: str = "id") -> DataFrame:
    """Each non-anchor row of a long table beside the anchor value of its ``key``.

    A key has one row for each column, so the rows of a key meet in one pass. A
    key without an anchor row has none in the result.
    """
    own = Window.partitionBy(key)
    is_anchor = F.col("variable") == anchor
    met = long.select(
        "*",
        F.max(F.when(is_anchor, F.col("value"))).over(own).alias("anchor_value"),
        F.max(is_anchor).over(own).alias("__has_anchor"),
    )
    return met.filter((F.col("variable") != anchor) & F.col("__has_anchor") & F.col(key).isNotNull()).drop("__has_anchor")


def join_predictions(a: DataFrame, b: DataFrame, key: str = "t_id") -> DataFrame:
    return a.join(b, key)


def bind_by_key(dfs: list[DataFrame], key: str) -> DataFrame:
    """Put tables side by side by ``key``; a key that is NULL, repeated, or missing on one side raises.

    The check is a filter on the joined rows, so it holds whatever columns are read.
    """

    def counted(df: DataFrame, n: str) -> DataFrame:
        return df.withColumn(n, F.count("*").over(Window.partitionBy(key)))

    def bind(a: DataFrame, b: DataFrame) -> DataFrame:
        both = counted(a, "__left").join(counted(b, "__right"), key, "full")
        text = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
        once = F.coalesce((F.col("__left") == 1) & (F.col("__right") == 1), F.lit(False))
        repeated = (F.col("__left") > 1) | (F.col("__right") > 1)
        message = F.when(repeated, F.concat(F.lit(f"{key} is repeated: "), text)).otherwise(
            F.concat(F.lit(f"{key} without a partner: "), text)
        )
        rest = [F.col(c) for c in [*a.columns, *b.columns] if c != key]
        return both.filter(F.when(once, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(key, *rest)

    return reduce(bind, dfs)


def bind_by_order(a: DataFrame, a_order, b: DataFrame, b_order) -> DataFrame:
    """Side by side by position, for tables without a common key.

    Each side needs a total order; unequal row counts raise.
    """
    return bind_by_key([add_row_id(a, a_order, "row_id"), add_row_id(b, b_order, "row_id")], "row_id")
