"""Blends of model scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.columns import flip, when_agree


def equal(*cols: str) -> dict[str, float]:
    """Equal weights for ``blend``."""
    return {c: 1.0 / len(cols) for c in cols}


def blend(
    df: DataFrame,
    blends: dict[str, dict[str, float]],
    flip_cols: list[str] | tuple = (),
    only_if: dict[str, tuple[str, str, str]] | None = None,
) -> DataFrame:
    """Add one column per blend: ``{name: {score column: weight}}``.

    Columns in ``flip_cols`` enter as ``1 - score``. ``only_if`` maps a blend
    to ``(a, b, fallback)``: it applies where columns ``a`` and ``b`` agree.
    """

    def member(c: str) -> Column:
        return flip(c) if c in flip_cols else F.col(c)

    def weighted(weights: dict[str, float]) -> Column:
        if abs(sum(weights.values()) - 1.0) > 1e-9:
            raise ValueError(f"weights sum to {sum(weights.values())}, not 1")
        if len(set(weights.values())) == 1:  # equal weights: sum first, divide once
            return reduce(add, [member(c) for c in weights]) / F.lit(float(len(weights)))
        return reduce(add, [F.lit(float(w)) * member(c) for c, w in weights.items()])

    out = {}
    for name, weights in blends.items():
        value = weighted(weights)
        if only_if and name in only_if:
            a, b, fallback = only_if[name]
            value = when_agree(a, b, value, F.col(fallback))
        out[name] = value
    return df.withColumns(out)
