"""Global order without a global window.

``row_number() over (order by ...)`` without a partition sends the whole table
to one task. These operators range-partition by the order, number or sum inside
each range, and add the total of the earlier ranges: a table with one row per
range (and per group that crosses a range border), which is the only thing
that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.sources.scratch import materialize

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def order_columns(order_by: str | Column | list[str | Column]) -> list[Column]:
    items = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(o) if isinstance(o, str) else o for o in items]


def number_within_ranges(df: DataFrame, order_by) -> DataFrame:
    """Add ``__at``: range number in the high bits, position inside it in the low bits."""
    order = order_columns(order_by)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("*", F.monotonically_increasing_id().alias("__at"))


def range_of(at: str = "__at") -> Column:
    return F.shiftright(F.col(at), _POSITION_BITS)


def position_of(at: str = "__at") -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def add_row_id(df: DataFrame, order_by, name: str = "id") -> DataFrame:
    """Number the rows 1..N in ``order_by`` order (which must be a total order)."""
    numbered = materialize(number_within_ranges(df, order_by), "row-id")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy(range_of().alias("__range"))
        .agg(F.count("*").alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    return (
        numbered.withColumn("__range", range_of())
        .join(F.broadcast(starts), "__range")
        .select((F.col("__start") + position_of() + 1).alias(name), *[F.col(c) for c in df.columns])
    )


def prefix_sums(df: DataFrame, order_by, cols: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """Add ``<col>_cum``, the running sum in ``order_by`` order (inside each ``by`` group).

    ``order_by`` must be a total order inside the group. A group may span any
    number of ranges, so a hot group is spread like any other rows.
    """
    by, order = list(by), order_columns(order_by)
    running = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__range", F.spark_partition_id())
    local = materialize(
        ranged.select("*", *[F.sum(c).over(running).alias(f"__run_{c}") for c in cols]), "prefix-sums"
    )
    # Only the first group of a range can have started in an earlier range, so
    # no more rows than ranges are left after the filter.
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        local.groupBy("__range", *by)
        .agg(*[F.sum(c).alias(f"__sum_{c}") for c in cols])
        .select(
            F.col("__range").alias("__r"),
            *[F.col(b).alias(f"__b_{b}") for b in by],
            F.count("*").over(earlier).alias("__earlier"),
            *[F.sum(f"__sum_{c}").over(earlier).alias(f"__start_{c}") for c in cols],
        )
        .filter("__earlier > 0")
    )
    match = F.col("__range") == F.col("__r")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__b_{b}"))

    def total(c: str) -> Column:
        start = F.coalesce(F.col(f"__start_{c}"), F.lit(0))
        return (F.col(f"__run_{c}") + start).alias(f"{c}_cum")

    return local.join(F.broadcast(starts), match, "left").select(
        *[F.col(c) for c in df.columns], *[total(c) for c in cols]
    )


def tag_ranges(df: DataFrame, value: str) -> DataFrame:
    """Add ``__range``: ranges of a double column that rise with it, NULL in the first, NaN in the last.

    The split points are quantiles of the values of ``df``, no more than the shuffle
    has partitions. Unlike a range exchange, the tag is a column: a window by it
    needs one exchange, and no other. Every column of ``df`` counts as used by the
    quantiles, so that they read the same exchange that ``df`` ends with.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(value)
    probs = F.array(*[F.lit((i + 1) / parts) for i in range(parts)])
    used = F.greatest(*[F.col(c).isNotNull().cast("int") for c in df.columns], F.lit(0)) >= 0
    splits = df.agg(F.array_distinct(F.percentile_approx(F.when(used, x), probs, 10 * parts)).alias("q")).scalar()
    place = F.size(F.filter(F.coalesce("__splits", F.array().cast("array<double>")), lambda s: s < x))
    tagged = df.withColumn("__splits", splits).withColumn("__range", F.when(x.isNull(), F.lit(-1)).otherwise(place))
    return tagged.drop("__splits")
