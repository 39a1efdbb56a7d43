"""Counts, statistics, correlations, quantiles, histograms."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.operators.reshape import to_long
from tabscore.sources.scratch import materialize, release

PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def max_of(df: DataFrame, col: str | Column, name: str = "max") -> DataFrame:
    return df.agg(F.max(col).alias(name))


def mean_and_sd(x: Column, na_policy: str = "propagate") -> tuple[Column, Column]:
    """Aggregates (mean, sample sd) of ``x``.

    ``propagate``: one NULL makes both NULL. ``skip``: NULLs are left out.
    """
    value = x.cast("double")
    mean, sd = F.avg(value), F.stddev_samp(value)
    if na_policy == "skip":
        return mean, sd
    if na_policy != "propagate":
        raise ValueError(f"unknown na_policy {na_policy!r}")
    complete = F.count(value) == F.count("*")
    return F.when(complete, mean), F.when(complete, sd)


def variable_stats(long: DataFrame, na_policy: str = "propagate", by: str = "variable") -> DataFrame:
    """Mean and sample sd per variable of a long table."""
    mean, sd = mean_and_sd(F.col("value"), na_policy)
    return long.groupBy(by).agg(mean.alias("mean"), sd.alias("sd"))


def any_of(conditions: Iterable[str]) -> Column:
    """Rows under at least one of the SQL conditions; others need no unpivot."""
    return F.expr(" or ".join(f"({c})" for c in conditions))


def population_stats(
    df: DataFrame, cols: list[str], populations: dict[str, str], na_policy: str = "propagate"
) -> DataFrame:
    """``variable, m_<p>, sd_<p>, ...`` for every population in one scan.

    ``populations`` maps a name to a SQL condition; they may overlap. A row is
    counted once, in the cell of populations it belongs to: it is unpivoted and
    pre-aggregated inside the scan stage, so a task sends one row per variable
    and cell. The few cells are then merged into populations.
    """
    if na_policy not in ("propagate", "skip"):
        raise ValueError(f"unknown na_policy {na_policy!r}")
    flags = {p: f"__in_{i}" for i, p in enumerate(populations)}
    long = to_long(
        df.filter(any_of(populations.values())).select(
            *[F.col(c).cast("double") for c in cols],
            *[F.coalesce(F.expr(populations[p]), F.lit(False)).alias(f) for p, f in flags.items()],
        ),
        list(flags.values()),
        cols,
    )
    cells = long.groupBy("variable", *flags.values()).agg(
        F.count("*").alias("rows"),
        F.count("value").alias("n"),
        F.avg("value").alias("m"),
        F.var_pop("value").alias("v"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    means, moments = Window.partitionBy("variable"), []
    for p, flag in flags.items():
        inside = F.col(flag) & (F.col("n") > 0)
        total = F.sum(F.when(inside, F.col("n") * F.col("m"))).over(means)
        moments.append((total / F.sum(F.when(inside, F.col("n"))).over(means)).alias(f"mean{flag}"))
    cells = cells.select("*", *moments)
    aggregates = []
    for p, flag in flags.items():
        inside, mean = F.col(flag) & (F.col("n") > 0), F.col(f"mean{flag}")
        n = F.sum(F.when(inside, F.col("n")))
        squares = F.sum(F.when(inside, F.col("n") * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean))))
        constant = F.min(F.when(inside, F.col("low"))) == F.max(F.when(inside, F.col("high")))
        known = F.lit(True)
        if na_policy == "propagate":
            known = F.sum(F.when(F.col(flag), F.col("rows") - F.col("n"))) == 0
        sd = F.when(constant, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(squares, n - 1)))
        aggregates += [
            F.when(known, F.max(F.when(inside, mean))).alias(f"m_{p}"),
            F.when(known & (n > 1), sd).alias(f"sd_{p}"),
        ]
    return cells.groupBy("variable").agg(*aggregates)


def _moments(names: list[str]):
    """Per task and column pair: rows, means, centred squares and products, pairwise complete.

    Batches are taken around one value of each column, so large means cost no digits.
    """
    k = len(names)
    first, second = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sums = np.full(k, np.nan), np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            there = ~np.isnan(x)
            for i in np.flatnonzero(np.isnan(centre) & there.any(axis=0)):
                centre[i] = np.quantile(x[there[:, i], i], 0.5, method="lower")
            z = np.where(there, x - centre, 0.0)
            m = there.astype(np.float64)
            squares = z * z
            sums += np.stack([m.T @ m, z.T @ m, m.T @ z, squares.T @ m, m.T @ squares, z.T @ z])
        n, sx, sy, sxx, syy, sxy = (t[first, second] for t in sums)
        used = n > 0
        n, sx, sy, sxx, syy, sxy, i, j = (v[used] for v in (n, sx, sy, sxx, syy, sxy, first, second))
        means = [centre[i] + sx / n, centre[j] + sy / n]
        spreads = [sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n]
        columns = [i.astype(np.int32), j.astype(np.int32), n, *means, *spreads]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "mx", "my", "vx", "vy", "c"])

    return run


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """``var_a, var_b, corr`` for all ordered pairs, pairwise complete; NULL and NaN are missing.

    A pair with a constant column is NULL. Each task reduces its rows to the
    moments of the column pairs by matrix products over Arrow batches; these few
    numbers are then merged around the common means.
    """
    names = list(dict.fromkeys(cols))
    values = df.select(*[F.col(c).cast("double") for c in names])
    schema = "i int, j int, n double, mx double, my double, vx double, vy double, c double"
    parts = values.mapInArrow(_moments(names), schema)
    pair = Window.partitionBy("i", "j")  # one row for each task
    n = F.sum("n").over(pair)
    about = parts.select(
        "*",
        (F.sum(F.col("n") * F.col("mx")).over(pair) / n).alias("ax"),
        (F.sum(F.col("n") * F.col("my")).over(pair) / n).alias("ay"),
    )
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")

    def spread(own: str, mean: str, off: Column) -> Column:
        constant = (F.max(own) <= 0) & (F.min(mean) == F.max(mean))
        return F.when(constant, F.lit(0.0)).otherwise(F.sum(F.col(own) + F.col("n") * off * off))

    size = F.sqrt(spread("vx", "mx", dx)) * F.sqrt(spread("vy", "my", dy))
    r = F.try_divide(F.sum(F.col("c") + F.col("n") * dx * dy), size)
    per_pair = about.groupBy("i", "j").agg(r.alias("r"))
    # a pair of columns that never meet has no row above
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    every = every.select("i", F.explode(F.sequence(F.col("i"), F.lit(len(names) - 1))).alias("j"))
    known = every.join(per_pair, ["i", "j"], "left")
    label = F.array(*[F.lit(c) for c in names])
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    half = known.select(F.explode(F.array_distinct(both)).alias("p"), "r").select("p.a", "p.b", "r")
    entry = F.when(F.col("a") != F.col("b"), F.col("r")).when(F.col("r").isNotNull(), F.lit(1.0))
    return half.select(F.get(label, "a").alias("var_a"), F.get(label, "b").alias("var_b"), entry.alias("corr"))


def corr_max(corr: DataFrame, mask_ones: bool = True) -> DataFrame:
    """Largest signed correlation per feature.

    Entries that equal 1 count as 0, so a duplicate of a feature is hidden;
    ``mask_ones=False`` masks only the diagonal.
    """
    masked = F.abs(F.col("corr") - 1.0) < 1e-12 if mask_ones else F.col("var_a") == F.col("var_b")
    return corr.groupBy(F.col("var_a").alias("variable")).agg(
        F.max(F.when(masked, 0.0).otherwise(F.col("corr"))).alias("max_corr")
    )


def corr_mean(corr: DataFrame) -> DataFrame:
    """Mean correlation per feature with the diagonal counted as 0."""
    off = F.when(F.col("var_a") == F.col("var_b"), 0.0).otherwise(F.col("corr"))
    return corr.groupBy(F.col("var_a").alias("variable")).agg(
        (F.sum(off) / F.count("*")).alias("mean_corr")
    )


BUCKETS = 512  # of each open interval in a pass
LISTED = 20_000  # rows of the open intervals that are few enough to list their values


def _bucketed(values: DataFrame, spans: list[tuple]) -> list:
    """Count, least and greatest value of each bucket of the open intervals: one pass, pre-aggregated in each task.

    Infinite values have the buckets below and above the equal ones between the
    interval's finite ends.
    """
    spark = values.sparkSession
    table = spark.createDataFrame(spans, "variable string, span int, least double, most double, low double, high double")
    met = values.join(F.broadcast(table), "variable").filter("value between least and most")
    half = [F.col(c) / 2 for c in ("value", "low", "high")]  # the width of all doubles would be infinite
    equal = F.least(F.floor((half[0] - half[1]) / (half[2] - half[1]) * BUCKETS), F.lit(BUCKETS - 1)) + 1
    bucket = (
        F.when(F.col("value") < F.col("low"), 0)
        .when(F.col("value") > F.col("high"), BUCKETS + 1)
        .when(F.col("low") >= F.col("high"), 1)
        .otherwise(equal)
    )
    counts = met.groupBy("variable", "span", bucket.alias("bucket"))
    counts = counts.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return sorted(counts.collect(), key=lambda r: r["bucket"])  # intervals x buckets


def _listed(values: DataFrame, spans: list[tuple]) -> list:
    """Every value of the open intervals, which hold few rows, with its count."""
    table = values.sparkSession.createDataFrame([s[:4] for s in spans], "variable string, span int, least double, most double")
    met = values.join(F.broadcast(table), "variable").filter("value between least and most")
    counts = met.groupBy("variable", "span", "value").agg(F.count("*").alias("n")).collect()
    return sorted(counts, key=lambda r: r["value"])


def select_ranks(values: DataFrame, ends: dict, ranks: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks (from 1) of each variable, by counting in ever smaller intervals.

    Each pass counts the buckets of the open intervals and keeps those that hold a
    rank, with their own least and greatest values; a bucket of one value is an answer. No
    row travels, and nothing is ordered but counts.
    """
    found: dict[tuple[str, int], float] = {}
    # variable, least and greatest value, rows before, rows inside, ranks inside
    spans = [(v, *ends[v][:2], 0, ends[v][2], sorted(r)) for v, r in ranks.items() if r]
    while spans:
        asked = []
        for i, (v, least, most, _, _, _) in enumerate(spans):
            low, high = max(least, -sys.float_info.max), min(most, sys.float_info.max)
            asked.append((v, i, least, most, low, high))
        few = sum(s[4] for s in spans) <= LISTED
        rows = _listed(values, asked) if few else _bucketed(values, asked)
        cells: dict[int, list] = {}
        for r in rows:
            least, most = (r["value"], r["value"]) if few else (r["least"], r["most"])
            cells.setdefault(r["span"], []).append((least, most, r["n"]))
        again = []
        for i, (v, _, _, before, _, wanted) in enumerate(spans):
            for least, most, n in cells[i]:
                inside = [r for r in wanted if before < r <= before + n]
                if inside and least == most:
                    found |= {(v, r): least for r in inside}
                elif inside:
                    again.append((v, least, most, before, n, inside))
                before += n
        spans = again
    return found


def _order_statistics(df: DataFrame, cols: list[str], probs: tuple[float, ...]) -> DataFrame:
    """Per variable: ``qs`` (array of quantiles in ``probs`` order), ``mean``, ``total``."""
    names = list(dict.fromkeys(cols))
    wide = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in names]), "quantiles")
    values = to_long(wide, [], names).filter("value is not null and not isnan(value)")
    totals = values.groupBy("variable").agg(
        F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"), F.avg("value").alias("mean")
    )
    seen = {r["variable"]: r for r in totals.collect()}  # one row for each column
    ends = {v: (r["least"], r["most"], r["n"]) for v, r in seen.items()}
    spots = {v: [(n - 1) * float(p) for p in probs] for v, (_, _, n) in ends.items()}
    ranks = {v: {k + 1 for h in hs for k in (math.floor(h), math.ceil(h))} for v, hs in spots.items()}
    at = select_ranks(values, ends, ranks)
    release(wide)
    out = []
    for v, hs in spots.items():
        qs = []
        for h in hs:
            low, high = at[v, math.floor(h) + 1], at[v, math.ceil(h) + 1]
            qs.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        out.append((v, seen[v]["mean"], seen[v]["n"], qs))
    return df.sparkSession.createDataFrame(out, "variable string, mean double, total long, qs array<double>")


def quantile_profile(
    df: DataFrame, cols: list[str], probs: tuple[float, ...] = PROBS, accuracy: int | None = None
) -> DataFrame:
    """``variable, prob, quantile`` with linear interpolation between ranks.

    Exact by default, in a few passes that count buckets; ``accuracy`` switches to the sketch of
    ``percentile_approx``, one pass. NULL and NaN are left out.
    """
    if accuracy is None:
        stats = _order_statistics(df, cols, probs)
    else:
        long = to_long(df.select(*[F.col(c).cast("double") for c in cols]), [], cols)
        sketch = F.percentile_approx("value", F.array(*[F.lit(float(p)) for p in probs]), accuracy)
        stats = long.filter("not isnan(value)").groupBy("variable").agg(sketch.alias("qs"))
    return stats.select("variable", F.posexplode("qs").alias("i", "quantile")).select(
        "variable", F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i")).alias("prob"), "quantile"
    )


def six_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """``variable, min, q1, median, mean, q3, max``."""
    stats = _order_statistics(df, cols, (0.0, 0.25, 0.5, 0.75, 1.0))
    q = [F.get(F.col("qs"), F.lit(i)) for i in range(5)]
    return stats.select(
        "variable",
        q[0].alias("min"),
        q[1].alias("q1"),
        q[2].alias("median"),
        "mean",
        q[3].alias("q3"),
        q[4].alias("max"),
    )


def contingency(df: DataFrame, a: str, b: str, wide: bool = False) -> DataFrame:
    """Joint counts of ``a`` and ``b``; rows with a NULL on either side are not counted."""
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if not wide:
        return count_by(known, a, b)
    return known.groupBy(a).pivot(b).count().fillna(0)


def bin_number(x: Column, width: Column | float) -> Column:
    """Bins centred on multiples of ``width``, closed on the right."""
    return F.ceil(x.cast("double") / width - 0.5)


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """``bin, center, n`` for the bins that hold rows; NULL and NaN are in none."""
    x = F.col(col).cast("double")
    counts = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(bin_number(F.col(col), F.lit(width)).alias("bin"))
    return counts.agg(F.count("*").alias("n")).select(
        "bin", (F.col("bin") * F.lit(float(width))).alias("center"), "n"
    )


def histogram_bins(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Histogram with ``bins`` equal-width bins over the range of ``col``; NULL and NaN are in none."""
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    width = df.agg(F.nullif((F.max(x) - F.min(x)) / F.lit(float(bins - 1)), F.lit(0.0)).alias("w")).scalar()
    known = df.filter(x.isNotNull())
    counts = known.groupBy(F.coalesce(bin_number(x, width), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("bin") * width).alias("center"), "n")


def histogram_by(df: DataFrame, cols: list[str], width: float) -> DataFrame:
    """``variable, bin, n``: one histogram per column on common bins; NULL and NaN are in none."""
    long = to_long(df.select(*[F.col(c).cast("double") for c in cols]), [], cols)
    return (
        long.filter("value is not null and not isnan(value)")
        .groupBy("variable", bin_number(F.col("value"), F.lit(width)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
