"""Boosted trees against plain loops over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.models import boost as b

COLS = ["a", "b", "c"]


def table(spark, n=700, gaps=True, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), np.round(rng.normal(size=n), 1), rng.integers(0, 3, n)]).astype(float)
    y = ((x[:, 0] > 6) & (x[:, 1] < 0.4) | (rng.random(n) < 0.1)).astype(int)
    if gaps:
        x[rng.random(x.shape) < 0.05] = np.nan
    rows = [(i, int(t), *[None if np.isnan(v) and i % 2 else v for v in r]) for i, (t, r) in enumerate(zip(y, x.tolist()))]
    return spark.createDataFrame(rows, "id long, target int, a double, b double, c double"), x, y.astype(float)


def brute_tree(s, x, g, h, edges_of):
    """A tree by going through all rows for each node: what the passes should find."""
    def node(rows):
        return {"rows": rows, "cut": cut(rows)}

    def cut(rows):
        best = None
        for f in range(x.shape[1]):
            v, missing = x[rows, f], np.isnan(x[rows, f])
            for t in edges_of(v[~missing], f):
                for missing_left in (True, False) if missing.any() else (True,):
                    left = np.where(missing, missing_left, v <= t)
                    sides = [rows[left], rows[~left]]
                    if any(len(r) < max(s.min_rows, 1) or h[r].sum() < s.min_hessian - 1e-9 for r in sides):
                        continue
                    weight = (lambda r: h[r].sum() + s.reg_lambda) if s.criterion == "newton" else len
                    gain = sum(g[r].sum() ** 2 / weight(r) for r in sides) - g[rows].sum() ** 2 / weight(rows)
                    if gain > max(s.min_gain, 1e-9 * max(1, len(rows))) and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, f, t, missing_left, sides)
        return best

    leaves, splits = [(0, node(np.arange(len(x))))], []
    while True:
        open_ = [(d, n) for d, n in leaves if n["cut"] and (s.splits is not None or d < s.depth)]
        if not open_ or (s.splits is not None and len(splits) == s.splits):
            break
        d, n = max(open_, key=lambda p: p[1]["cut"][0]) if s.splits is not None else open_[0]
        splits.append(n["cut"][:4])
        leaves = [p for p in leaves if p[1] is not n] + [(d + 1, node(r)) for r in n["cut"][4]]
    value = np.zeros(len(x))
    for _, n in leaves:
        weight = h[n["rows"]].sum() + (s.reg_lambda if s.criterion == "newton" else 0)
        value[n["rows"]] = -s.eta * g[n["rows"]].sum() / weight
    return splits, len(leaves), value


def check(spark, s, edges, gaps=True):
    df, x, y = table(spark, gaps=gaps)
    model = ts.boost(df, COLS, **s.__dict__)
    trees = ts.boost_trees(model).collect()
    m = np.full(len(x), np.log(y.mean() / (1 - y.mean())) if s.start == "mean" else s.start)
    for i in range(1, s.rounds + 1):
        p = 1 / (1 + np.exp(-m))
        splits, leaves, value = brute_tree(s, x, p - y, p * (1 - p), edges)
        m += value
        mine = sorted((r for r in trees if r["tree"] == i and r["feature"]), key=lambda r: r["split_order"])
        assert sum(r["tree"] == i and not r["feature"] for r in trees) == leaves
        got = [(r["gain"], COLS.index(r["feature"]), r["threshold"]) for r in mine]
        assert sorted(np.round(got, 6).tolist()) == sorted(np.round([q[:3] for q in splits], 6).tolist())
        if s.splits is not None:  # in the order of growth
            assert np.round(got, 6).tolist() == np.round([q[:3] for q in splits], 6).tolist()
    scored = {r["id"]: r["p1"] for r in ts.score(model, df, "id").collect()}
    np.testing.assert_allclose([scored[i] for i in range(len(x))], 1 / (1 + np.exp(-m)), atol=1e-9)
    return model


def every_value(v, f):
    """The greatest value parts the known values from the missing ones."""
    return np.unique(v)


@pytest.mark.parametrize(
    "options",
    [
        {"rounds": 3, "depth": 3, "eta": 0.3},
        {"rounds": 2, "depth": 2, "eta": 0.5, "reg_lambda": 3.0, "min_gain": 2.0, "min_hessian": 5.0},
        {"rounds": 2, "splits": 5, "eta": 0.1, "min_rows": 20},
        {"rounds": 2, "splits": 4, "criterion": "variance", "start": "mean", "min_hessian": 0.0, "min_rows": 5},
    ],
)
def test_global_bins_are_brute_force(spark, options):
    check(spark, b.BoostSettings(bins=255, **options), every_value)


@pytest.mark.parametrize("options", [{"rounds": 2, "depth": 3}, {"rounds": 2, "splits": 4}])
def test_bins_by_node_are_brute_force(spark, options):
    def own_range(v, f):
        if not len(v) or v.max() == v.min():
            return np.unique(v)
        return [*(v.min() + np.arange(1, 8) * ((v.max() - v.min()) / 8)), v.max()]

    check(spark, b.BoostSettings(bins=8, binning="node", eta=0.3, **options), own_range)


def test_splits_come_in_the_order_of_their_gains(spark):
    """k splits give k + 1 leaves; of the leaves open at each step the one of greatest gain is split."""
    df, _, _ = table(spark)
    trees = ts.boost_trees(ts.boost(df, COLS, rounds=2, splits=7, bins=255)).collect()
    for i in (1, 2):
        nodes = {r["node"]: r for r in trees if r["tree"] == i}
        split = sorted((r for r in nodes.values() if r["feature"]), key=lambda r: r["split_order"])
        assert [r["split_order"] for r in split] == list(range(1, 8)) and len(nodes) - len(split) == 8
        open_ = {0}
        for r in split:
            gains = {n: nodes[n]["gain"] or 0 for n in open_}
            assert r["gain"] == max(gains.values())
            open_ = open_ - {r["node"]} | {r["left_node"], r["right_node"]}


def test_bins_by_node_find_what_quantiles_cannot(spark):
    """All but a few rows lie below 1; the target turns at 500 of 0..1000 in the rest."""
    rng = np.random.default_rng(0)
    tail = rng.uniform(0, 1000, 60)
    x = np.concatenate([rng.random(6000), tail])
    rows = spark.createDataFrame([(i, int(v > 500), float(v)) for i, v in enumerate(x)], "id long, target int, a double")
    options = {"rounds": 1, "depth": 4, "bins": 16, "eta": 1.0, "min_hessian": 0.0, "reg_lambda": 0.01}
    wrong = {}
    for binning in ("global", "node"):
        scored = ts.score(ts.boost(rows, ["a"], binning=binning, **options), rows, "id", keep=["target"]).filter("id >= 6000")
        wrong[binning] = scored.filter((F.col("p1") > 0.5) != (F.col("target") == 1)).count()
    assert wrong["node"] <= 1 and wrong["global"] >= 20


def test_deep_trees_and_bags(spark):
    df, x, y = table(spark, 900)
    one, two = [ts.boost(df, COLS, rounds=3, depth=25, eta=0.5, bag=0.5, bins=255, min_hessian=0.0) for _ in range(2)]
    trees = ts.boost_trees(one).collect()
    assert trees == ts.boost_trees(two).collect()  # the same bag for the same seed
    seen = [r["n_rows"] for r in trees if r["node"] == 0]
    assert all(390 < n < 510 for n in seen) and len(set(seen)) > 1
    assert max(r["node"] for r in trees) > 60
    area = ts.auc(ts.score(one, df, "id", "p1", ["target"]), "target", "p1").first()["auc"]
    assert area > 0.9


def test_stages_are_shorter_fits(spark, monkeypatch):
    monkeypatch.setattr(b, "STORED_AFTER", 2)  # margins are stored within the fit
    df, _, _ = table(spark)
    long, short = [ts.boost(df, COLS, rounds=n, depth=2) for n in (5, 3)]
    stage = {r["id"]: r["score"] for r in ts.boost_stages(long, df, ["id"], [3]).collect()}
    whole = {r["id"]: r["score"] for r in ts.boost_stages(short, df, ["id"]).filter("round = 3").collect()}
    assert all(abs(stage[i] - whole[i]) < 1e-12 for i in stage) and len(stage) == df.count()
    shares = {r["feature"]: r["share"] for r in ts.boost_importance(long).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) in ("a", "b")


def test_stored_models_and_narrow_cases(spark, tmp_path):
    df, _, _ = table(spark, 60)
    model = ts.boost(df, COLS, rounds=2, depth=2, train_fraction=0.5)
    ts.save_model(model, f"{tmp_path}/m")
    assert ts.score(ts.load_model(f"{tmp_path}/m"), df, "id").collect() == ts.score(model, df, "id").collect()
    flat = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(2))
    for binning in ("global", "node"):
        trees = ts.boost_trees(ts.boost(flat, COLS, rounds=1, binning=binning)).collect()
        assert len(trees) == 1 and trees[0]["n_rows"] == 60
    with pytest.raises(ValueError, match="criterion"):
        b.BoostSettings(criterion="x")
