import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.operators.metrics import stop_round


def frame(spark, pairs):
    rows = [(i, y, s) for i, (y, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, y int, s double")


def brute_average(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_order(pairs):
    """By definition: walk down the scores, ties in row order."""
    ranked = sorted(enumerate(pairs), key=lambda t: (-t[1][1], t[0]))
    total = sum(y for y, _ in pairs)
    if total in (0, len(pairs)):
        return None
    seen = above = 0.0
    for rank, (_, (y, _)) in enumerate(ranked, 1):
        seen += y
        above += (rank - seen) * y
    return 1 - above / (total * (len(pairs) - total))


def value(df):
    return df.first()["auc"]


PAIRS = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9])), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=PAIRS)
def test_auc_against_all_pairs(spark, pairs):
    df = frame(spark, pairs)
    for got, expected in (
        (value(ts.auc(df, "y", "s")), brute_average(pairs)),
        (value(ts.auc(df, "y", "s", ties="order", order_by="id")), brute_order(pairs)),
    ):
        assert got == (None if expected is None else pytest.approx(expected, abs=1e-12))


def sample(n=400, seed=5):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.4), rng.choice([0.5, round(rng.random(), 2)])) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_auc_does_not_depend_on_partitions(spark, partitions, n):
    partitions(n)
    pairs = sample()
    df = frame(spark, pairs).repartition(n)
    assert value(ts.auc(df, "y", "s")) == pytest.approx(brute_average(pairs), abs=1e-12)
    assert value(ts.auc(df, "y", "s", ties="order", order_by="id")) == pytest.approx(brute_order(pairs), abs=1e-12)


def test_auc_invariances(spark):
    df = frame(spark, sample())
    base = value(ts.auc(df, "y", "s"))
    assert value(ts.auc(df.withColumn("t", F.exp("s") * 3), "y", "t")) == pytest.approx(base, abs=1e-12)
    assert value(ts.auc(df.withColumn("t", -F.col("s")), "y", "t")) == pytest.approx(1 - base, abs=1e-12)


def test_auc_equals_the_evaluator_without_bins(spark):
    df = frame(spark, sample()).withColumn("y", F.col("y").cast("double"))
    exact = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert value(ts.auc(df, "y", "s")) == pytest.approx(exact, abs=1e-12)


@pytest.mark.parametrize("ties", ["average", "order"])
def test_grouped_auc_with_a_hot_group(spark, partitions, ties):
    partitions(5)
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 6}", i, int(rng.random() < 0.5), rng.randrange(20) / 20) for i in range(500)]
    rows += [("one", 900, 1, 0.5), ("one", 901, 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, id int, y int, s double")
    got = {r.g: r.auc for r in ts.auc(df, "y", "s", ["g"], ties, "id").collect()}
    brute = brute_average if ties == "average" else brute_order
    for g in {r[0] for r in rows}:
        expected = brute([(y, s) for h, _, y, s in sorted(rows, key=lambda r: r[1]) if h == g])
        assert got[g] == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_fractional_outcome(spark):
    rng = random.Random(7)
    pairs = [(round(rng.random(), 3), rng.randrange(2)) for _ in range(100)]
    df = spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "id int, y double, s double")
    got = value(ts.auc(df, "y", "s", ties="order", order_by="id", fractional=True))
    assert got == pytest.approx(brute_order(pairs), abs=1e-12)


def test_bad_arguments(spark):
    df = frame(spark, [(0, 0.1), (1, 0.2)])
    with pytest.raises(ValueError):
        ts.auc(df, "y", "s", ties="order")
    with pytest.raises(ValueError):
        ts.auc(df, "y", "s", ties="first")
    with pytest.raises(ValueError):
        ts.auc(df, "y", "s", fractional=True)
    with pytest.raises(Exception, match="must be 0 or 1"):
        ts.auc(df.withColumn("y", F.col("y") + 1), "y", "s").collect()
    with pytest.raises(Exception, match="must be 0 or 1"):
        ts.auc(df.withColumn("y", F.lit(None).cast("int")), "y", "s").collect()


def test_null_score_ranks_lowest(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, 0.0), (3, 1, 1.0)], "id int, y int, s double")
    assert value(ts.auc(df, "y", "s")) == 0.5
    assert value(ts.auc(df, "y", "s", ties="order", order_by="id")) == 0.5


def test_performance(spark):
    df = frame(spark, [(1, 0.9), (0, 0.6), (0, 0.2), (1, 0.4)])
    r = ts.performance(df, "y", "s").first()
    assert (r.n, r.tp, r.fp, r.tn, r["fn"]) == (4, 1, 1, 1, 1)
    assert r.accuracy == 0.5 and r.auc == 0.75
    assert r.mse == pytest.approx((0.01 + 0.36 + 0.04 + 0.36) / 4)


def test_performance_by_group_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), (None, 1, 0.2), (None, 0, 0.7)], "g string, y int, s double")
    assert {r.g: r.auc for r in ts.performance(df, "y", "s", by=["g"]).collect()} == {"a": 1.0, None: 0.0}


def test_accuracy(spark):
    assert ts.accuracy(frame(spark, [(1, 1.0), (0, 1.0)]), "y", "s").first().accuracy == 0.5


def naive_stop(values, k, tol, maximize):
    means = {t: sum(values[t - k : t]) / k for t in range(k, len(values) + 1)}
    for t in range(2 * k, len(values) + 1):
        last, before = [means[u] for u in range(t - k + 1, t + 1)], means[t - k]
        gain = max(last) - before if maximize else before - min(last)
        if gain < abs(before) * tol:
            return t
    return None


@pytest.mark.parametrize("maximize", [True, False])
@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_early_stop(spark, k, maximize):
    curve = [0.5, 0.55, 0.58, 0.6, 0.605, 0.606, 0.606, 0.605, 0.607, 0.606]
    if not maximize:
        curve = [1 - v for v in curve]
    expected = naive_stop(curve, k, 1e-2, maximize) if k else None
    assert stop_round(curve, k, 1e-2, maximize) == expected
    history = spark.createDataFrame([("m", i, v) for i, v in enumerate(curve, 1)], "model_id string, round int, metric double")
    assert ts.early_stop(history, k, 1e-2, maximize).first().stop_round == expected


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_performance_needs_a_score_in_every_row(spark, bad):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, bad)], "y int, s double")
    for report in (ts.performance(df, "y", "s"), ts.performance(df, "y", "s").select("n"), ts.performance(df, "y", "s", by=["y"])):
        with pytest.raises(Exception, match="NULL or NaN"):
            report.collect()


def brute_sweep(pairs):
    """tp, fp, tn, fn at each distinct score, by counting all rows for each."""
    out = {}
    for t in {s for _, s in pairs}:
        hit = [(y, s >= t) for y, s in pairs]
        out[t] = tuple(sum((y == 1) == a and yes == b for y, yes in hit) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=PAIRS)
def test_sweep_against_counting(spark, pairs):
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in ts.threshold_sweep(frame(spark, pairs), "y", "s").collect()}
    assert got == brute_sweep(pairs)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_sweep_by_group_with_a_hot_score(spark, partitions, n):
    partitions(n)
    pairs = [(y, 0.5 if i % 3 else s) for i, (y, s) in enumerate(sample(500))]
    df = frame(spark, pairs).withColumn("g", F.expr("case when id % 5 = 0 then null else id % 2 end"))
    got = {}
    for r in ts.threshold_sweep(df, "y", "s", ["g"]).collect():
        got.setdefault(r["g"], {})[r["threshold"]] = (r["tp"], r["fp"], r["tn"], r["fn"])
    groups = {}
    for i, pair in enumerate(pairs):
        groups.setdefault(None if i % 5 == 0 else i % 2, []).append(pair)
    assert got == {g: brute_sweep(p) for g, p in groups.items()}
    best = {(r["g"], r["metric"]): r for r in ts.best_thresholds(df, "y", "s", ["g"]).collect()}
    assert len(best) == 3 * 10
    for g, counts in got.items():
        f1 = {t: 2 * tp / (2 * tp + fp + fn) for t, (tp, fp, _, fn) in counts.items()}
        r = best[g, "f1"]
        assert r["value"] == max(f1.values())
        assert r["threshold"] == max(t for t, v in f1.items() if v == r["value"])
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == counts[r["threshold"]]


def test_gains_and_lift(spark):
    pairs = sample(333)
    parts = ts.gains_lift(frame(spark, pairs), "y", "s", 10).orderBy("group").collect()
    rate = sum(y for y, _ in pairs) / len(pairs)
    part_of = {}
    for t in {s for _, s in pairs}:
        part_of[t] = sum(s > t for _, s in pairs) * 10 // len(pairs) + 1
    assert [r["group"] for r in parts] == sorted(set(part_of.values()))
    seen = pos = 0
    for r in parts:
        mine = [y for y, s in pairs if part_of[s] == r["group"]]
        seen, pos = seen + len(mine), pos + sum(mine)
        assert (r["n"], r["n_pos"], r["cum_n"], r["cum_pos"]) == (len(mine), sum(mine), seen, pos)
        assert r["lift"] == pytest.approx(sum(mine) / len(mine) / rate)
        assert r["cum_capture"] == pytest.approx(pos / (rate * len(pairs)))
        assert r["lower"] == min(t for t, part in part_of.items() if part == r["group"])
    assert seen == len(pairs) and parts[-1]["cum_lift"] == pytest.approx(1.0)


def test_sweep_of_one_class_and_of_nothing(spark):
    rows = {r["threshold"]: r for r in ts.threshold_sweep(frame(spark, [(0, 0.2), (0, 0.7)]), "y", "s").collect()}
    assert rows[0.7]["recall"] is None and rows[0.7]["specificity"] == 0.5 and rows[0.7]["mean_class_accuracy"] is None
    assert ts.threshold_sweep(frame(spark, []), "y", "s").count() == 0
    assert ts.gains_lift(frame(spark, []), "y", "s").count() == 0
    with pytest.raises(Exception, match="s is NULL or NaN"):
        ts.threshold_sweep(frame(spark, [(1, None)]), "y", "s").collect()


def test_auc_of_null_and_nan_scores(spark):
    """NULL ranks lowest, NaN highest, whatever the ranges."""
    pairs = [(1, None), (0, None), (0, 0.3), (1, 0.4), (0, float("nan")), (1, float("nan")), (1, -1.0), (0, float("-inf"))]
    rank = {None: -3.0, "nan": 9.0}
    plain = [(y, rank[None] if s is None else rank["nan"] if s != s else max(s, -2.0)) for y, s in pairs]
    assert value(ts.auc(frame(spark, pairs), "y", "s")) == pytest.approx(brute_average(plain))
