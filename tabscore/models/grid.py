"""Hyper-parameter grids on a fixed validation split."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.models.gbt import gbt, staged_scores
from tabscore.models.net import NetSettings, NetState, NetTrainer, scored_rows, with_options
from tabscore.models.score import score_many
from tabscore.operators.metrics import auc, stop_round
from tabscore.operators.reshape import to_long

SCORED_TOGETHER = 16  # models whose validation scores share one scan and one AUC job


def expand_grid(grid: dict[str, Iterable]) -> list[dict]:
    """All combinations in order."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def fit_all(make: Callable[..., PipelineModel], settings: list[dict], train: DataFrame, parallelism: int = 2) -> list:
    """``make(train, **setting)`` for every setting, a few fits at a time."""

    def run(setting: dict) -> PipelineModel:
        return make(train, **setting)

    with ThreadPoolExecutor(parallelism) as pool:
        tasks = [pool.submit(inheritable_thread_target(train.sparkSession)(run), s) for s in settings]
        return [t.result() for t in tasks]


def _settings_frame(df: DataFrame, settings: list[dict]) -> DataFrame:
    rows = [{"model_id": f"model_{i}", **{k: _plain(v) for k, v in s.items()}} for i, s in enumerate(settings, 1)]
    return df.sparkSession.createDataFrame(rows).select("model_id", *settings[0])


def _plain(value):
    return list(value) if isinstance(value, tuple) else value


def grid_search(
    make: Callable[..., PipelineModel],
    grid: dict[str, Iterable],
    train: DataFrame,
    valid: DataFrame,
    label: str = "target",
    key: str = "id",
    metric: Callable[[DataFrame, str, str], DataFrame] | None = None,
    parallelism: int = 2,
    in_sample: bool = False,
) -> DataFrame:
    """``model_id, <settings>, auc, in_sample``: one row per fitted setting.

    ``train`` and ``valid`` are read many times: pass stored tables.
    ``metric(scores, label, 'p1')`` replaces the AUC: ``scores`` holds the rows
    of all models, and the metric returns ``model_id`` and one value column.
    ``in_sample`` marks settings fitted on the rows that judge them.
    """
    settings = expand_grid(grid)
    measure = metric or (lambda scores, y, p: auc(scores, y, p, ["model_id"]))
    parts = []
    for start in range(0, len(settings), SCORED_TOGETHER):
        # the driver holds the models of one batch, until their metrics are computed
        models = fit_all(make, settings[start : start + SCORED_TOGETHER], train, parallelism)
        batch = {f"model_{i}": m for i, m in enumerate(models, start + 1)}
        scores = score_many(batch, valid, key, [label])
        part = measure(to_long(scores, [key, label], list(batch), "model_id", "p1"), label, "p1")
        parts.append(train.sparkSession.createDataFrame(part.collect(), part.schema))  # one row for each model
    measured = reduce(DataFrame.unionByName, parts)
    return (
        _settings_frame(train, settings)
        .join(measured, "model_id")
        .withColumn("in_sample", F.lit(in_sample))
    )


def gbt_grid(
    train: DataFrame,
    valid: DataFrame,
    cols: list[str],
    rounds: list[int],
    depths: list[int],
    etas: list[float],
    label: str = "target",
    seed: int = 2016,
    parallelism: int = 2,
) -> DataFrame:
    """``model_id, ntrees, max_depth, learn_rate, auc, in_sample`` for boosted trees.

    The first k trees of a longer fit are the k-round fit, so one fit per
    (depth, rate) serves every number of rounds.
    """
    settings = expand_grid({"ntrees": rounds, "max_depth": depths, "learn_rate": etas})
    longest: dict[tuple[int, float], set[int]] = {}
    for s in settings:
        longest.setdefault((s["max_depth"], s["learn_rate"]), set()).add(s["ntrees"])
    fits = [{"depth": d, "eta": e, "rounds": max(n)} for (d, e), n in longest.items()]

    def make(data: DataFrame, **s) -> PipelineModel:
        return gbt(data, cols, seed=seed, label=label, **s)

    parts = []
    for start in range(0, len(fits), SCORED_TOGETHER):
        # the driver holds the models of one batch; one job measures all their rounds
        batch = fits[start : start + SCORED_TOGETHER]
        scores = [
            staged_scores(model, valid, [label], sorted(longest[(fit["depth"], fit["eta"])])).select(
                label,
                "score",
                F.col("round").alias("ntrees"),
                F.lit(fit["depth"]).alias("max_depth"),
                F.lit(fit["eta"]).alias("learn_rate"),
            )
            for fit, model in zip(batch, fit_all(make, batch, train, parallelism))
        ]
        part = auc(reduce(DataFrame.unionByName, scores), label, "score", ["ntrees", "max_depth", "learn_rate"])
        parts.append(train.sparkSession.createDataFrame(part.collect(), part.schema))  # one row for each setting
    measured = reduce(DataFrame.unionByName, parts)
    ids = _settings_frame(train, settings)
    ids = ids.withColumns({"ntrees": F.col("ntrees").cast("int"), "max_depth": F.col("max_depth").cast("int")})
    return ids.join(measured, ["ntrees", "max_depth", "learn_rate"]).select(
        "model_id", "ntrees", "max_depth", "learn_rate", "auc", F.lit(False).alias("in_sample")
    )


def refit(make: Callable[..., PipelineModel], params: dict, df: DataFrame) -> PipelineModel:
    """Fit the chosen setting on other rows (all of them, for the final model)."""
    return make(df, **params)


STOPPING = ("epochs", "stopping_rounds", "stopping_tolerance")


def net_grid(
    train: DataFrame,
    valid: DataFrame,
    cols: list[str],
    grid: dict[str, Iterable],
    label: str = "target",
    key: str = "id",
    epochs: int = 10,
    stopping_rounds: int = 5,
    stopping_tolerance: float = 1e-3,
    tasks: int | None = None,
    seed: int = 2016,
) -> tuple[DataFrame, DataFrame, dict[str, tuple[NetSettings, NetState]]]:
    """Nets that train side by side and stop by their own rules: results, history, best nets.

    ``grid`` names fields of ``NetSettings`` and, if wanted, ``epochs``,
    ``stopping_rounds`` and ``stopping_tolerance``. Settings that differ in these three only
    are one net, judged by several rules. Every pass over the training rows is one
    epoch of all nets of a batch that no rule has closed for good; one scan and one
    grouped job then measure their AUC on ``valid``.

    Results: ``model_id, <settings>, net_id, rounds, best_round, auc, early``, one row for each setting:
    the epochs it ran, and the best AUC among them. History: ``net_id, round, metric``, which
    ``early_stop`` reads. The third value has each setting's net at its best round.
    """
    if valid.select(label).distinct().count() < 2:
        raise ValueError("the validation rows hold one class only, so they have no AUC")
    settings = expand_grid(grid)
    rules = [
        (int(s.get("epochs", epochs)), int(s.get("stopping_rounds", stopping_rounds)), s.get("stopping_tolerance", stopping_tolerance))
        for s in settings
    ]
    base = NetSettings(seed=seed)
    nets: dict[NetSettings, list[int]] = {}
    for i, s in enumerate(settings):
        nets.setdefault(with_options(base, {k: v for k, v in s.items() if k not in STOPPING}), []).append(i)
    names = {own: f"net_{n}" for n, own in enumerate(nets, 1)}
    history: dict[NetSettings, list[float]] = {own: [] for own in nets}
    ran: dict[int, tuple[int, bool]] = {}
    best: dict[int, tuple[float, int, NetState]] = {}
    trainer = NetTrainer(train, list(cols), label, key, seed, tasks)
    everything = list(nets)
    for start in range(0, len(everything), SCORED_TOGETHER):
        states = {own: NetState.start(own, len(cols)) for own in everything[start : start + SCORED_TOGETHER]}
        epoch = 0
        while states:
            states = dict(zip(states, trainer.average(list(states), list(states.values()), epoch)))
            epoch += 1
            scored = scored_rows(valid, cols, label, {names[own]: (own, state) for own, state in states.items()})
            areas = {r["model_id"]: r["auc"] for r in auc(scored, label, "score", ["model_id"]).collect()}
            for own in list(states):
                history[own].append(areas[names[own]])
                open_rules = [i for i in nets[own] if i not in ran]
                for i in open_rules:
                    if i not in best or areas[names[own]] > best[i][0]:
                        best[i] = (areas[names[own]], epoch, states[own])
                    most, rounds, tol = rules[i]
                    early = stop_round(history[own], rounds, tol) is not None
                    if early or epoch >= most:
                        ran[i] = (epoch, early)
                if all(i in ran for i in nets[own]):
                    del states[own]
    trainer.close()
    spark = train.sparkSession
    owner = {i: own for own, members in nets.items() for i in members}
    outcome = [
        (f"model_{i + 1}", names[owner[i]], ran[i][0], best[i][1], best[i][0], ran[i][1]) for i in range(len(settings))
    ]
    measured = spark.createDataFrame(
        outcome, "model_id string, net_id string, rounds int, best_round int, auc double, early boolean"
    )
    told = [(names[own], r, m) for own, values in history.items() for r, m in enumerate(values, 1)]
    table = spark.createDataFrame(told, "net_id string, round int, metric double")
    kept = {f"model_{i + 1}": (owner[i], best[i][2]) for i in range(len(settings))}
    return _settings_frame(train, settings).join(measured, "model_id"), table, kept
