"""Boosted trees: fit, best round, staged scores, importance."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.models.score import score
from tabscore.operators.metrics import auc
from tabscore.operators.ordered import add_row_id
from tabscore.operators.reshape import to_long
from tabscore.sources.scratch import materialize

SWAPPED_TOGETHER = 16  # columns whose permuted scores share one scan


def first_fraction(df: DataFrame, key: str, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(the first ``fraction`` of the rows in ``key`` order, the rest); ``key`` is unique and never NULL."""
    if not df.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is NULL in some rows")
    ranked = add_row_id(df.select(key), key, "rank")
    last = F.floor(F.lit(fraction) * F.lit(df.count())).cast("long")
    cut = ranked.filter(F.col("rank") <= last).agg(F.max(key)).first()[0]
    if cut is None:  # the fraction is less than one row
        return df.limit(0), df
    return df.filter(F.col(key) <= F.lit(cut)), df.filter(F.col(key) > F.lit(cut))


def gbt(
    df: DataFrame,
    cols: list[str],
    depth: int,
    eta: float,
    rounds: int,
    seed: int = 2016,
    label: str = "target",
    min_rows: int = 1,
    train_fraction: float | None = None,
    key: str = "id",
    bins: int = 32,
    subsample: float = 1.0,
) -> PipelineModel:
    """Boosted trees with logistic loss.

    ``train_fraction`` fits on the first part of the rows in ``key`` order.
    """
    if train_fraction is not None:
        df, _ = first_fraction(df, key, train_fraction)
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    learner = GBTClassifier(
        labelCol=label,
        maxDepth=depth,
        stepSize=eta,
        maxIter=rounds,
        seed=seed,
        minInstancesPerNode=min_rows,
        maxBins=bins,
        subsamplingRate=subsample,
        maxMemoryInMB=512,
    )
    # assemble before the fit: the tree rounds then read one narrow vector column
    fitted = learner.fit(assembler.transform(df.select(label, *cols)).select(label, "features"))
    return PipelineModel([assembler, fitted])


def _parts(model: PipelineModel) -> tuple[VectorAssembler, GBTClassificationModel]:
    return model.stages[0], model.stages[-1]


def deviance_by_round(model: PipelineModel, df: DataFrame) -> list[float]:
    """Bernoulli deviance after each round, one pass over ``df``."""
    assembler, trees = _parts(model)
    label = trees.getLabelCol()
    data = assembler.transform(df).select(F.col(label).cast("double").alias(label), "features")
    return list(trees.evaluateEachIteration(data))


def best_rounds(model: PipelineModel, valid: DataFrame) -> int:
    """Number of trees with the lowest deviance on ``valid``."""
    losses = deviance_by_round(model, valid)
    return min(range(len(losses)), key=losses.__getitem__) + 1


def staged_scores(
    model: PipelineModel, df: DataFrame, keep: Iterable[str], rounds: Iterable[int] | None = None
) -> DataFrame:
    """``*keep, round, score``: the raw score after each round (or the given rounds)."""
    assembler, trees = _parts(model)
    data, names = assembler.transform(df), []
    for i, tree in enumerate(trees.trees):
        names.append(f"__tree_{i}")
        data = tree.copy().setFeaturesCol("features").setPredictionCol(names[-1]).transform(data)
    weighted = F.array(*[F.col(n) * F.lit(float(w)) for n, w in zip(names, trees.treeWeights)])
    wanted = list(rounds) if rounds is not None else list(range(1, len(names) + 1))
    none = F.array().cast("array<double>")

    def add(acc, t):
        return F.struct((acc["sum"] + t).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + t)).alias("all"))

    running = F.aggregate(weighted, F.struct(F.lit(0.0).alias("sum"), none.alias("all")), add)["all"]

    def pick(sums):
        return F.transform(
            F.array(*[F.lit(r) for r in wanted]),
            lambda r: F.struct(r.alias("round"), F.element_at(sums, r).alias("score")),
        )

    # the outer transform computes the running sums once for all rounds
    return data.select(*keep, F.inline(F.get(F.transform(F.array(running), pick), 0)))


def staged_auc(
    model: PipelineModel, df: DataFrame, label: str = "target", rounds: Iterable[int] | None = None
) -> DataFrame:
    """``round, auc`` after each boosting round: one job for all rounds."""
    return auc(staged_scores(model, df, [label], rounds), label, "score", ["round"])


def watchlist(
    model: PipelineModel,
    splits: dict[str, DataFrame],
    label: str = "target",
    rounds: Iterable[int] | None = None,
    metric: Callable[[DataFrame, str, str, list[str]], DataFrame] | None = None,
    model_id: str = "model_1",
) -> DataFrame:
    """``model_id, round, split, metric`` after each round on every split, in one job.

    ``metric(scores, label, 'score', by)`` replaces the AUC; it returns ``by`` and one
    value. The table is what ``early_stop`` reads, for one split of it.
    """
    parts = [
        staged_scores(model, df, [label], None if rounds is None else list(rounds)).withColumn("split", F.lit(name))
        for name, df in splits.items()
    ]
    scores = reduce(DataFrame.unionByName, parts).withColumn("model_id", F.lit(model_id))
    return metric_history(scores, label, metric=metric)


def metric_history(
    scores: DataFrame,
    label: str = "target",
    score: str = "score",
    metric: Callable[[DataFrame, str, str, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """``model_id, round, split, metric`` of scored rows that carry these three names."""
    by = ["model_id", "round", "split"]
    table = (metric or auc)(scores, label, score, by)
    value = next(c for c in table.columns if c not in by)
    return table.select(*by, F.col(value).alias("metric"))


def importance(model: PipelineModel) -> DataFrame:
    """``feature, share`` of the split gains, largest first."""
    assembler, trees = _parts(model)
    rows = list(zip(assembler.getInputCols(), trees.featureImportances.toArray().tolist()))
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "feature string, share double").orderBy(F.desc("share"), "feature")


def permutation_importance(
    model: PipelineModel, df: DataFrame, cols: list[str], key: str = "id", label: str = "target", seed: int = 2016
) -> DataFrame:
    """``feature, auc_drop`` when a column is shuffled, for any scoring model.

    Rows are put in one random order and every row also gets the values of the
    row before it (the first row those of the last): one join shuffles all
    columns. A scan then scores the rows with each column swapped in turn.
    """
    inputs = model.stages[0].getInputCols()
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    ranked = add_row_id(df.select(key, label, *inputs), order, "__rank")
    total = df.agg(F.count("*").alias("n")).scalar()
    others = ranked.select(
        (F.col("__rank") % total + 1).alias("__rank"), *[F.col(c).alias(f"__other_{c}") for c in cols]
    )
    pairs = materialize(ranked.join(others, "__rank"), "permuted")

    parts = [auc(score(model, pairs, key, "p1", [label]), label, "p1").select(F.lit("").alias("feature"), "auc")]
    for start in range(0, len(cols), SWAPPED_TOGETHER):
        batch = cols[start : start + SWAPPED_TOGETHER]
        scored = pairs
        for c in batch:
            swapped = scored.withColumnRenamed(c, "__kept").withColumnRenamed(f"__other_{c}", c)
            names = [n for n in swapped.columns if n not in (c, "__kept")]
            one = score(model, swapped, names, f"__p_{c}", ["__kept"])
            scored = one.withColumnRenamed("__kept", c)
        scores = scored.select(key, label, *[F.col(f"__p_{c}").alias(c) for c in batch])
        parts.append(auc(to_long(scores, [key, label], batch, "feature", "p1"), label, "p1", ["feature"]))
    by_feature = materialize(reduce(DataFrame.unionByName, parts), "importance")
    whole = by_feature.filter("feature = ''").select("auc").scalar()
    return by_feature.filter("feature <> ''").select("feature", (whole - F.col("auc")).alias("auc_drop"))
