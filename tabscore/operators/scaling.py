"""Scaling policies: one statistics pass, one projection.

A fit returns a small frozen model that holds a handful of numbers per column.
Its transform writes them into the projection as literals, so scaling a table
is a narrow scan: no shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.columns import product, square, z
from tabscore.operators.joins import join_anchor, lookup_stats
from tabscore.operators.profile import any_of, mean_and_sd, population_stats, variable_stats
from tabscore.operators.reshape import to_long
from tabscore.sources.scratch import materialize

Stat = tuple[float | None, float | None]


def first_match(conditions: Iterable[str], values: list[Column]) -> Column:
    """The value beside the first SQL condition that holds, else NULL."""
    out = F
    for condition, value in zip(conditions, values, strict=True):
        out = out.when(F.expr(condition), value)
    return out


@dataclass(frozen=True)
class ScalerModel:
    cols: tuple[str, ...]
    stats: dict[str, dict[str, Stat]]  # population -> column -> (mean, sd)

    def columns(self) -> list[Column]:
        return [
            z(c, *by_col[c]).alias(f"{c}_{p}" if p else c) for p, by_col in self.stats.items() for c in self.cols
        ]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (default: all but the raw ones) and the scaled columns."""
        keep = [c for c in df.columns if c not in self.cols] if keep is None else keep
        return df.select(*keep, *self.columns())


@dataclass(frozen=True)
class Scaler:
    """Scale ``cols`` by one or several populations.

    ``populations`` maps an output suffix to a SQL condition on the fitted
    table; the suffix ``''`` keeps the column names.
    """

    cols: tuple[str, ...]
    populations: dict[str, str]
    na_policy: str = "propagate"

    def fit(self, df: DataFrame) -> ScalerModel:
        numbered = {str(i): cond for i, cond in enumerate(self.populations.values())}
        rows = population_stats(df, list(self.cols), numbered, self.na_policy).collect()  # one row per column
        found = {r["variable"]: r for r in rows}

        def stat(c: str, i: int) -> Stat:
            return (found[c][f"m_{i}"], found[c][f"sd_{i}"]) if c in found else (None, None)

        return ScalerModel(
            tuple(self.cols),
            {p: {c: stat(c, i) for c in self.cols} for i, p in enumerate(self.populations)},
        )


@dataclass(frozen=True)
class SplitScalerModel:
    cols: tuple[str, ...]
    splits: dict[str, str]
    squares: bool
    anchor: str | None
    stats: dict[str, dict[str, dict[str, Stat]]]  # kind -> split -> column -> (mean, sd)

    def _by_split(self, kind: str, col: str, value: Column) -> Column:
        stats = [self.stats[kind][s][col] for s in self.splits]
        conditions = list(self.splits.values())
        if len(stats) == 1:
            return F.when(F.expr(conditions[0]), z(value, *stats[0]))

        def pick(i: int) -> Column:
            return first_match(conditions, [F.lit(stat[i]).cast("double") for stat in stats])

        return z(value, pick(0), pick(1))

    def columns(self) -> list[Column]:
        out = [self._by_split("value", c, F.col(c)).alias(f"{c}_mn") for c in self.cols]
        if self.squares:
            out += [self._by_split("square", c, square(c)).alias(f"{c}_mn_sq") for c in self.cols]
        if self.anchor:
            out += [
                self._by_split("product", c, product(c, self.anchor)).alias(f"{c}_prod")
                for c in self.cols
                if c != self.anchor
            ]
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in df.columns if c not in self.cols] if keep is None else keep
        return df.select(*keep, *self.columns())


@dataclass(frozen=True)
class SplitScaler:
    """Scale every split by its own statistics, with squares and anchor products.

    ``splits`` maps a name to a SQL condition. A row belongs to the first one
    that holds; a row in no split gets NULLs.
    """

    cols: tuple[str, ...]
    splits: dict[str, str]
    squares: bool = True
    anchor: str | None = "f5"
    na_policy: str = "propagate"

    def fit(self, df: DataFrame) -> SplitScalerModel:
        split = first_match(self.splits.values(), [F.lit(i) for i in range(len(self.splits))])
        anchor = F.col(self.anchor).cast("double") if self.anchor else F.lit(None).cast("double")
        long = to_long(
            df.filter(any_of(self.splits.values())).select(
                *[F.col(c).cast("double") for c in self.cols], anchor.alias("__anchor"), split.alias("__split")
            ),
            ["__anchor", "__split"],
            list(self.cols),
        )
        kinds = {"value": F.col("value")}
        if self.squares:
            kinds["square"] = square("value")
        if self.anchor:
            kinds["product"] = product("value", "__anchor")
        aggregates = []
        for kind, x in kinds.items():
            mean, sd = mean_and_sd(x, self.na_policy)
            aggregates += [mean.alias(f"m_{kind}"), sd.alias(f"sd_{kind}")]
        # one row per column and split
        rows = long.groupBy("variable", "__split").agg(*aggregates).collect()
        found = {(r["variable"], r["__split"]): r for r in rows}

        def stat(kind: str, i: int, c: str) -> Stat:
            r = found.get((c, i))
            return (None, None) if r is None else (r[f"m_{kind}"], r[f"sd_{kind}"])

        stats = {
            kind: {s: {c: stat(kind, i, c) for c in self.cols} for i, s in enumerate(self.splits)} for kind in kinds
        }
        return SplitScalerModel(tuple(self.cols), dict(self.splits), self.squares, self.anchor, stats)


def zscore(long: DataFrame, by: str = "variable", na_policy: str = "propagate") -> DataFrame:
    """Group mean, sd and z-score beside every row of a long table.

    A window over ``by`` would sort one huge group per variable in one task;
    the statistics are pre-aggregated and looked up instead.
    """
    stats = variable_stats(long, na_policy, by)
    return lookup_stats(long, stats, by).withColumn("z", z("value", F.col("mean"), F.col("sd")))


def zscore_product(long: DataFrame, anchor: str, by: str = "variable", key: str = "id") -> DataFrame:
    """Z-score of ``value * anchor value`` per variable of a long table."""
    products = join_anchor(long, anchor, key).select(
        key, by, product("value", "anchor_value").alias("value")
    )
    return zscore(materialize(products, "products"), by)
