"""Column functions: plain expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coalesce_cols(*cols: Column | str) -> Column:
    return F.coalesce(*cols)


def when_agree(a: Column | str, b: Column | str, x: Column | str, y: Column | str) -> Column:
    """``x`` where ``a`` equals ``b``, else ``y``; NULL where either side is NULL."""
    same = _c(a) == _c(b)
    return F.when(same, _c(x)).when(~same, _c(y))


def split_code(col: Column | str) -> tuple[Column, Column]:
    """Split ``token<separator>number`` at non-alphanumerics.

    Missing parts and parts that are not numbers become NULL; parts beyond the
    second are dropped.
    """
    parts = F.split(_c(col), "[^A-Za-z0-9]+")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")


def fits_bits(col: Column | str, width: int) -> Column:
    """The value itself, or an error where it needs more than ``width`` bits."""
    n = _c(col)
    message = F.concat(F.lit("code "), n.cast("string"), F.lit(f" does not fit in {width} bits"))
    return F.when(n.isNull() | n.between(0, 2**width - 1), n).otherwise(F.raise_error(message))


def to_binary(col: Column | str, width: int) -> Column:
    """Binary text padded to ``width``; a larger value raises, it is never cut."""
    return F.lpad(F.bin(fits_bits(col, width)), width, "0")


def bit_columns(df: DataFrame, col: Column | str, width: int, prefix: str = "c_") -> DataFrame:
    """Add ``prefix1..prefix<width>``, the most significant bit first."""
    # two projections: the code is parsed once a row, not once a bit
    coded = df.withColumn("__n", _c(col)).withColumn("__n", fits_bits("__n", width))
    bits = [F.getbit("__n", F.lit(width - i)).cast("int").alias(f"{prefix}{i}") for i in range(1, width + 1)]
    return coded.select(*df.columns, *bits)


def z(col: Column | str, mean: Column | float | None, sd: Column | float | None) -> Column:
    """Z-score; NULL where the standard deviation is 0 or unknown."""
    if mean is None or sd is None or (isinstance(sd, (int, float)) and sd == 0):
        return F.lit(None).cast("double")
    x = _c(col).cast("double")
    if isinstance(sd, (int, float)):
        return (x - mean) / F.lit(float(sd))
    return (x - mean) / F.nullif(sd, F.lit(0.0))


def square(col: Column | str) -> Column:
    x = _c(col).cast("double")
    return x * x


def product(a: Column | str, b: Column | str) -> Column:
    return _c(a).cast("double") * _c(b).cast("double")


def blend_mean(*cols: Column | str) -> Column:
    """Equal-weight mean; NULL if any member is NULL."""
    return reduce(add, [_c(c) for c in cols]) / F.lit(float(len(cols)))


def blend_weighted(weights: dict[str, float]) -> Column:
    """Weighted mean; the weights must sum to 1."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")
    return reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def flip(col: Column | str) -> Column:
    return F.lit(1.0) - _c(col)


def format_metric(fmt: str, *cols: Column | str) -> Column:
    return F.format_string(fmt, *[_c(c) for c in cols])
