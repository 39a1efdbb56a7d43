import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.operators.profile import PROBS


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 5, 300).astype(float)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=300)
    pdf.loc[rng.integers(0, 300, 30), "c"] = None
    pdf["k"] = 4.0
    pdf["d"] = pdf.a
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if v != v else float(v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, k double, d double")


def test_statistics_and_na_policy(spark, df, frame):
    long = ts.to_long(df, [], ["a", "c", "k"])
    kept = {r.variable: r for r in ts.variable_stats(long, "skip").collect()}
    assert kept["c"].mean == pytest.approx(frame.c.mean()) and kept["c"].sd == pytest.approx(frame.c.std())
    strict = {r.variable: r for r in ts.variable_stats(long).collect()}
    assert strict["c"].mean is None and strict["c"].sd is None
    assert strict["a"].sd == pytest.approx(frame.a.std())
    assert strict["k"].sd == 0
    with pytest.raises(ValueError):
        ts.variable_stats(long, "drop")


def test_single_row_has_no_sd(spark):
    one = spark.createDataFrame([("f1", 3.0)], "variable string, value double")
    assert ts.variable_stats(one).first().sd is None


def test_population_stats(spark, df, frame):
    out = {r.variable: r for r in ts.population_stats(df, ["a", "b"], {"all": "true", "low": "b < 2"}).collect()}
    low = frame[frame.b < 2]
    assert out["a"].m_low == pytest.approx(low.a.mean()) and out["a"].sd_low == pytest.approx(low.a.std())
    assert out["b"].m_all == pytest.approx(frame.b.mean())


def test_overlapping_populations_merge_their_cells(spark, df, frame):
    populations = {"all": "true", "low": "b < 3", "odd": "b % 2 = 1", "none": "b > 90", "one": "a = (b - b) + 99"}
    for policy in ("skip", "propagate"):
        out = {r.variable: r for r in ts.population_stats(df, ["a", "c", "k"], populations, policy).collect()}
        for p, part in {"all": frame, "low": frame[frame.b < 3], "odd": frame[frame.b % 2 == 1]}.items():
            for c in "ac":
                gaps = policy == "propagate" and part[c].isna().any()
                assert out[c][f"m_{p}"] == (None if gaps else pytest.approx(part[c].mean()))
                assert out[c][f"sd_{p}"] == (None if gaps else pytest.approx(part[c].std()))
            assert out["k"][f"m_{p}"] == 4.0 and out["k"][f"sd_{p}"] == 0.0
        assert out["a"].m_none is None and out["a"].sd_none is None


def test_constant_column_that_is_no_binary_fraction(spark):
    df = spark.range(1000).select("id", F.lit(0.1).alias("x"), (F.lit(1e6) + F.col("id") % 2).alias("y"))
    out = {r.variable: r for r in ts.population_stats(df, ["x", "y"], {"a": "true", "b": "id % 3 = 0"}).collect()}
    assert out["x"].sd_a == 0 and out["x"].sd_b == 0
    assert out["y"].sd_a == pytest.approx(0.5002501876563868, rel=1e-9)


def test_corr_is_pairwise_complete(df, frame):
    corr = {(r.var_a, r.var_b): r["corr"] for r in ts.corr_matrix(df, list("abckd")).collect()}
    assert len(corr) == 25
    expected = frame[list("abcd")].corr()
    for x in "abcd":
        for y in "abcd":
            assert corr[x, y] == pytest.approx(expected.loc[x, y], abs=1e-12)
    assert corr["a", "a"] == 1.0
    assert all(corr["k", x] is None and corr[x, "k"] is None for x in "abckd")


def test_corr_max_and_mean(spark):
    corr = spark.createDataFrame(
        [("a", "a", 1.0), ("a", "b", -0.5), ("b", "a", -0.5), ("b", "b", 1.0), ("c", "c", 1.0), ("c", "a", 1.0), ("c", "b", 0.2)],
        "var_a string, var_b string, corr double",
    )
    masked = {r.variable: r.max_corr for r in ts.corr_max(corr).collect()}
    assert masked == {"a": 0.0, "b": 0.0, "c": 0.2}  # only negative values: the masked diagonal wins
    assert {r.variable: r.max_corr for r in ts.corr_max(corr, mask_ones=False).collect()}["c"] == 1.0
    assert {r.variable: r.mean_corr for r in ts.corr_mean(corr).collect()}["c"] == pytest.approx(0.4)


def test_quantiles_are_type_7(df, frame, partitions):
    for n in (1, 4, 7):
        partitions(n)
        got = {(r.variable, r.prob): r.quantile for r in ts.quantile_profile(df, ["a", "b", "c"]).collect()}
        for c in "abc":
            assert [got[c, p] for p in PROBS] == pytest.approx(list(frame[c].dropna().quantile(PROBS)))


@pytest.mark.parametrize("buckets, listed", [(2, 0), (512, 0), (5, 40)])
def test_quantiles_of_awkward_values(spark, monkeypatch, buckets, listed):
    """Infinite, huge, tiny, tied and skewed values, with intervals that stay open for many passes."""
    from tabscore.operators import profile

    monkeypatch.setattr(profile, "BUCKETS", buckets)
    monkeypatch.setattr(profile, "LISTED", listed)
    rng = np.random.default_rng(4)
    values = {
        "skew": np.exp(rng.uniform(-9, 9, 90)),
        "tied": np.array([1.0] * 70 + [0.0] * 19 + [7.5]),
        "wide": np.concatenate([[-1.7e308, 1.7e308, -math.inf, math.inf, 5e-324, 0.0], rng.normal(size=84)]),
        "one": np.full(90, -3.25),
    }
    df = spark.createDataFrame(pd.DataFrame(values))
    probs = (0.0, 0.013, 0.25, 0.5, 0.77, 0.99, 1.0)
    got = {(r.variable, r.prob): r.quantile for r in ts.quantile_profile(df, list(values), probs).collect()}
    for c, v in values.items():
        ordered = np.sort(v)
        for p in probs:
            h = 89 * p
            low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
            want = low if low == high else low + (high - low) * (h - math.floor(h))
            assert got[c, p] == want or (math.isnan(want) and math.isnan(got[c, p]))


def test_quantiles_move_no_rows(spark, df):
    """What a pass exchanges is counted before: buckets, not rows."""
    from tabscore.operators.profile import _bucketed, to_long

    long = to_long(df.select(F.col("a").cast("double")), [], ["a"])
    seen = []
    monitor = pytest.MonkeyPatch()
    with monitor.context() as m:
        collect = type(df).collect
        m.setattr(type(df), "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
        _bucketed(long, [("a", 0, -9.0, 9.0, -9.0, 9.0)])
    lines = seen[0].splitlines()
    first = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert "HashAggregate" in lines[first + 1] and "partial_count" in lines[first + 1]
    assert "rangepartitioning" not in seen[0]


def test_approximate_quantiles_are_close(df, frame):
    got = {r.prob: r.quantile for r in ts.quantile_profile(df, ["a"], (0.1, 0.5, 0.9), accuracy=1000).collect()}
    assert got[0.5] == pytest.approx(frame.a.median(), abs=0.05)


def test_six_numbers(df, frame):
    r = ts.six_numbers(df, ["a", "c"]).filter("variable = 'c'").first()
    c = frame.c.dropna()
    expected = [c.min(), c.quantile(0.25), c.median(), c.mean(), c.quantile(0.75), c.max()]
    assert [r.min, r.q1, r.median, r.mean, r.q3, r.max] == pytest.approx(expected)


def test_histogram_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, -0.49, 0.0, 0.5, 0.51, 1.5, None)], "x double")
    got = {r.bin: r.n for r in ts.histogram(df, "x", 1.0).collect()}
    assert got == {-1: 1, 0: 3, 1: 2}


def test_histogram_over_a_range(spark, df, frame):
    got = {r.bin: r.n for r in ts.histogram_bins(df, "a").collect()}
    w = (frame.a.max() - frame.a.min()) / 29
    expected = pd.Series([math.ceil(x / w - 0.5) for x in frame.a]).value_counts().to_dict()
    assert got == expected
    assert [(r.n, r.bin) for r in ts.histogram_bins(df, "k").collect()] == [(300, 0)]


def test_contingency_skips_nulls(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, None), (1, 0)], "a int, b int")
    assert sorted(ts.contingency(df, "a", "b").collect()) == [(0, 1, 2), (1, 0, 1)]
    wide = {r.a: (r["0"], r["1"]) for r in ts.contingency(df, "a", "b", wide=True).collect()}
    assert wide == {0: (0, 2), 1: (1, 0)}


def test_nan_is_in_no_bin_and_no_quantile(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, None, float("nan"))], "v double")
    assert sorted((r.bin, r.n) for r in ts.histogram(df, "v", 1.0).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert sum(r.n for r in ts.histogram_bins(df, "v", 3).collect()) == 3
    assert sum(r.n for r in ts.histogram_by(df, ["v"], 1.0).collect()) == 3
    assert {r.prob: r.quantile for r in ts.quantile_profile(df, ["v"], (0.0, 1.0)).collect()} == {0.0: 0.0, 1.0: 2.0}
    assert ts.six_numbers(df, ["v"]).first().max == 2.0


def test_corr_keeps_its_digits_and_expands_no_row(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=5000)
    table = pd.DataFrame({"a": 1e9 + x, "b": 1e9 - x + rng.normal(size=5000), "k": 1e9 + 0.1, "x": x, "gone": None})
    df = spark.createDataFrame(table.astype({"gone": float})).repartition(7)
    out = ts.corr_matrix(df, ["a", "b", "k", "x", "gone"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Expand" not in plan
    corr = {(r.var_a, r.var_b): r["corr"] for r in out.collect()}
    assert len(corr) == 25
    assert corr["a", "b"] == pytest.approx(np.corrcoef(table.a - 1e9, table.b - 1e9)[0, 1], abs=1e-9)
    assert corr["x", "b"] == pytest.approx(np.corrcoef(table.x, table.b - 1e9)[0, 1], abs=1e-9)
    assert all(corr["k", c] is None and corr["gone", c] is None for c in ("a", "b", "k", "x", "gone"))
