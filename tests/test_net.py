"""Nets: gradients against differences, training against plain loops, stops against the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.models import net as nets
from tabscore.models.net import Layers, NetSettings, NetState, NetTrainer


def xor_rows(spark, n=1600):
    """A target that no single feature and no sum of features tells."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (n, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    return spark.createDataFrame([(i, int(t), *r) for i, (t, r) in enumerate(zip(y, x.tolist()))], "id long, target int, a double, b double, c double, d double")


COLS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("activation", nets.ACTIVATIONS)
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_is_that_of_finite_differences(activation, dropout):
    rng = np.random.default_rng(1)
    settings = NetSettings((5, 3), activation, dropout, (dropout, dropout) if dropout else ())
    layers = Layers(4, (5, 3), activation)
    flat = layers.start(3) + rng.normal(scale=0.1, size=layers.size)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    masks = nets.dropout_masks(settings, 4, rng.integers(0, 2**60, 9), 2)
    assert all((m is None) == (not dropout) for m in masks)
    loss, grad = layers.gradient(flat, x, y, masks)
    for i in range(layers.size):
        at = np.zeros(layers.size)
        at[i] = 1e-6
        up, down = layers.gradient(flat + at, x, y, masks)[0], layers.gradient(flat - at, x, y, masks)[0]
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5 * max(1, abs(grad[i]))
    assert loss > 0


def test_dropout_leaves_out_its_part_and_keeps_the_mean():
    settings = NetSettings((50,), input_dropout=0.2, hidden_dropout=(0.5,))
    masks = nets.dropout_masks(settings, 100, np.arange(4000), 0)
    for mask, ratio in zip(masks, (0.2, 0.5)):
        assert set(np.unique(mask)) == {0.0, 1 / (1 - ratio)}
        assert abs((mask == 0).mean() - ratio) < 0.01 and abs(mask.mean() - 1) < 0.01
    again = nets.dropout_masks(settings, 100, np.arange(4000)[::-1].copy(), 0)
    assert all((a == b[::-1]).all() for a, b in zip(masks, again))  # by row, in any order
    assert (nets.dropout_masks(settings, 100, np.arange(4000), 1)[0] != masks[0]).any()


def test_step_rules():
    layers = Layers(1, (), "tanh")
    g = np.array([0.5, -0.25])
    plain = NetState(np.array([1.0, 2.0]), np.zeros(2), np.zeros(2))
    s = NetSettings((), "tanh", adaptive=False, rate=0.1, momentum=0.9, nesterov=False, l1=0.01, l2=0.1)
    nets.step(s, layers, plain, g, 4)
    g1 = np.array([0.5 + 0.01 + 0.2, -0.25])  # the offset has no penalty
    np.testing.assert_allclose(plain.weights, [1.0 - 0.1 * g1[0], 2.0 + 0.025])
    velocity = plain.first.copy()
    ahead = NetState(np.array([1.0, 2.0]), velocity.copy(), np.zeros(2))
    nets.step(NetSettings((), "tanh", adaptive=False, rate=0.1, momentum=0.9), layers, ahead, g, 4)
    moved = 0.9 * velocity - 0.1 * g
    np.testing.assert_allclose(ahead.weights, np.array([1.0, 2.0]) + 0.9 * moved - 0.1 * g)
    bound = NetState(np.array([3.0, 4.0]), np.zeros(2), np.zeros(2))
    nets.step(NetSettings((), "tanh", adaptive=False, rate=0.0, max_w2=4.0), layers, bound, g, 1)
    np.testing.assert_allclose(bound.weights, [2.0, 4.0])
    a = NetState(np.array([1.0, 2.0]), np.zeros(2), np.zeros(2))
    nets.step(NetSettings((), "tanh", rho=0.9, epsilon=1e-6), layers, a, g, 1)
    first = -np.sqrt(1e-6) / np.sqrt(0.1 * g * g + 1e-6) * g
    np.testing.assert_allclose(a.weights, np.array([1.0, 2.0]) + first)
    np.testing.assert_allclose(a.second, 0.1 * first * first)


def stored(trainer):
    """The prepared rows as each task reads them."""
    parts = trainer.rows.select("__k", "__y", "__x", F.spark_partition_id().alias("p")).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r["p"], []).append(r)
    return [(np.array([r["__k"] for r in rows]), np.array([r["__y"] for r in rows]), np.array([r["__x"] for r in rows])) for rows in by_part.values()]


def plain_pass(settings, state, rows, epoch):
    k, y, x = rows
    groups = [(k[i : i + settings.batch], y[i : i + settings.batch], x[i : i + settings.batch]) for i in range(0, len(k), settings.batch)]
    return nets.learn_rows(settings, 4, state.copy(), iter(groups), epoch)


SETTINGS = NetSettings((6,), "maxout", 0.1, (0.2,), l1=1e-4, batch=30)


def test_averaging_over_one_task_is_plain_training(spark):
    trainer = NetTrainer(xor_rows(spark, 400), COLS, tasks=1)
    state = want = NetState.start(SETTINGS, 4)
    for epoch in range(2):
        (state,) = trainer.average([SETTINGS], [state], epoch)
        want = plain_pass(SETTINGS, want, stored(trainer)[0], epoch)
    np.testing.assert_allclose(state.weights, want.weights, atol=1e-12)
    assert state.rows == want.rows == 800  # two epochs of 400 rows
    trainer.close()


def test_averaging_weighs_tasks_by_their_rows(spark):
    other = NetSettings((3, 2), "tanh", batch=7, adaptive=False)
    trainer = NetTrainer(xor_rows(spark, 400), COLS, tasks=3)
    starts = [NetState.start(s, 4) for s in (SETTINGS, other)]
    both = trainer.average([SETTINGS, other], starts, 0)
    for s, start, got in zip((SETTINGS, other), starts, both):
        copies = [plain_pass(s, start, rows, 0) for rows in stored(trainer)]
        want = sum(c.weights * c.rows for c in copies) / 400
        np.testing.assert_allclose(got.weights, want, atol=1e-12)
        assert got.rows == 400  # one pass is one epoch for any number of tasks
    trainer.close()


def test_gradient_steps_use_each_batch_once_an_epoch(spark):
    trainer = NetTrainer(xor_rows(spark, 400), COLS, tasks=3, batches=4)
    got = nets.train_net(trainer, SETTINGS, 2, "gradient")
    rows = trainer.rows.collect()
    layers, state = Layers(4, (6,), "maxout"), NetState.start(SETTINGS, 4)
    order = np.random.default_rng(SETTINGS.seed)
    for epoch in range(2):
        for b in order.permutation(4):
            mine = [r for r in rows if r["__batch"] == b]
            k, y, x = (np.array([r[c] for r in mine]) for c in ("__k", "__y", "__x"))
            _, grad = layers.gradient(state.weights, x, y, nets.dropout_masks(SETTINGS, 4, k, epoch))
            nets.step(SETTINGS, layers, state, grad / len(mine), len(mine))
    np.testing.assert_allclose(got.weights, state.weights, atol=1e-10)
    assert got.rows == 800
    trainer.close()


@pytest.mark.parametrize(
    "options",
    [
        {"activation": "rectifier", "input_dropout": 0.0, "hidden_dropout": (0.1,), "l1": 1e-5},
        {"activation": "tanh"},
        {"activation": "maxout", "hidden_dropout": (0.2,)},
        {"activation": "tanh", "spread": "gradient", "batch": 100, "adaptive": False, "rate": 0.3, "momentum": 0.9, "epochs": 12},
    ],
)
def test_nets_learn_what_linear_models_cannot(spark, options):
    rows = xor_rows(spark)
    train, valid = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    made = {"epochs": 25, "tasks": 2, "hidden": (16,), "batch": 16} | options
    model = ts.net(train, COLS, **made)
    area = ts.auc(ts.score(model, valid, "id", "p1", ["target"]), "target", "p1").first()["auc"]
    assert area > 0.95
    shares = {r["feature"]: r["share"] for r in ts.net_importance(model).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9
    assert min(shares["a"], shares["b"]) > max(shares["c"], shares["d"])


def test_same_seed_same_weights_and_stored_models_score_alike(spark, tmp_path):
    rows = xor_rows(spark, 300)
    one, two = [ts.net(rows, COLS, (5,), 2, hidden_dropout=(0.3,), tasks=2, batch=20) for _ in range(2)]
    weights = [m.stages[-1].getOrDefault("weights") for m in (one, two)]
    assert weights[0] == weights[1]
    ts.save_model(one, f"{tmp_path}/net")
    again = ts.load_model(f"{tmp_path}/net")
    assert ts.score(again, rows, "id").collect() == ts.score(one, rows, "id").collect()


def test_refusals(spark):
    with pytest.raises(ValueError, match="activation"):
        NetSettings(activation="step")
    with pytest.raises(ValueError, match="each hidden layer"):
        NetSettings((3, 3), hidden_dropout=(0.5,))
    rows = xor_rows(spark, 20).withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(Exception, match="a is NULL or NaN"):
        ts.net(rows, COLS, (2,), 1)


def test_grid_stops_as_the_rule_on_the_table(spark):
    rows = xor_rows(spark, 600)
    train, valid = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    grid = {
        "hidden": [(8,), (4, 3)], "activation": ["tanh"], "batch": [16],
        "stopping_rounds": [0, 2, 3], "stopping_tolerance": [0.01, 0.3],
    }
    results, history, kept = ts.net_grid(train, valid, COLS, grid, epochs=9, tasks=2)
    found = results.collect()
    assert len(found) == 12 and len({r["net_id"] for r in found}) == 2
    table = history.collect()
    assert all(r["rounds"] <= 9 for r in found) and {r["net_id"] for r in table} == {"net_1", "net_2"}
    for r in found:
        mine = history.filter(F.col("net_id") == r["net_id"]).withColumnRenamed("net_id", "model_id")
        rule = ts.early_stop(mine, r["stopping_rounds"], r["stopping_tolerance"]).first()["stop_round"]
        assert (r["rounds"], r["early"]) == ((rule, True) if rule else (9, False))
        values = [x["metric"] for x in table if x["net_id"] == r["net_id"] and x["round"] <= r["rounds"]]
        assert r["auc"] == max(values) and r["best_round"] == values.index(max(values)) + 1
        settings, state = kept[r["model_id"]]
        model = nets.net_model(settings, state, COLS)
        area = ts.auc(ts.score(model, valid, "id", "p1", ["target"]), "target", "p1").first()["auc"]
        assert abs(area - r["auc"]) < 1e-12
    # a net runs on until its last rule closes it
    assert {r["net_id"]: max(x["round"] for x in table if x["net_id"] == r["net_id"]) for r in found} == {"net_1": 9, "net_2": 9}
