"""Clustered SVMs: one linear model over cluster blocks."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    Interaction,
    OneHotEncoder,
    SQLTransformer,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.models.mapped import MappedMargin, mapped_svm
from tabscore.models.stages import GatedMargin, MatrixProjection
from tabscore.operators.metrics import _binary
from tabscore.sources.scratch import discard, materialize


class _Chain:
    """Fit stages one after the other and remember them."""

    def __init__(self, df: DataFrame):
        self.df, self.stages = df, []

    def add(self, stage) -> _Chain:
        fitted = stage.fit(self.df) if hasattr(stage, "fit") else stage
        self.df = fitted.transform(self.df)
        self.stages.append(fitted)
        return self

    def finish(self) -> PipelineModel:
        """The pipeline, with its ``__`` columns dropped at the end."""
        gone = ", ".join(c for c in self.df.columns if c.startswith("__"))
        return PipelineModel([*self.stages, SQLTransformer(statement=f"SELECT * EXCEPT ({gone}) FROM __THIS__")])


def _blocks(chain: _Chain, x: str, cluster: str, out: str) -> _Chain:
    """``[x, onehot(cluster) (x) x]``: shared weights plus weights per cluster."""
    return (
        chain.add(OneHotEncoder(inputCol=cluster, outputCol="__hot", dropLast=False))
        .add(Interaction(inputCols=["__hot", x], outputCol="__blocks"))
        .add(VectorAssembler(inputCols=[x, "__blocks"], outputCol=out))
    )


def clustered_svm(
    df: DataFrame,
    cols: list[str],
    centers: int = 8,
    reg: float = 0.01,
    seed: int = 2016,
    label: str = "target",
    max_iter: int = 100,
) -> PipelineModel:
    """Clustered linear SVM: K-means, then one linear SVM over cluster blocks.

    The block vectors are sparse, so a row costs two copies of its features
    whatever the number of centers. Features should be scaled.
    """
    chain = _Chain(df.select(label, *cols))
    chain.add(VectorAssembler(inputCols=list(cols), outputCol="__x"))
    chain.add(KMeans(k=centers, seed=seed, featuresCol="__x", predictionCol="__cluster"))
    _blocks(chain, "__x", "__cluster", "__features")
    chain.add(
        LinearSVC(featuresCol="__features", labelCol=label, regParam=reg, maxIter=max_iter, rawPredictionCol="__raw")
    )
    return chain.finish()


def kernel_svm_approx(
    df: DataFrame,
    cols: list[str],
    k: int = 4,
    kernel: str = "gaussian",
    features: int = 64,
    reg: float = 0.01,
    seed: int = 2016,
    label: str = "target",
    gamma: float = 1.0,
    degree: int = 2,
    max_iter: int = 50,
) -> PipelineModel:
    """Divide-and-conquer kernel SVM with early prediction, approximated.

    K-means divides the rows; inside each cluster a linear SVM works on an
    explicit feature map of the kernel: ``features`` random Fourier features
    (``gaussian``) or all monomials up to ``degree`` (``polynomial``). Mapped rows
    are not stored (``mapped``).
    """
    width, waves = len(cols), []
    if kernel == "gaussian":
        rng, degree = np.random.default_rng(seed), 0
        w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(features, width))
        b = rng.uniform(0.0, 2.0 * np.pi, size=features)
        waves = np.column_stack([w, b]).tolist()
    elif kernel != "polynomial":
        raise ValueError(f"unknown kernel {kernel!r}")
    elif degree < 1:
        raise ValueError("degree must be 1 or more")
    chain = _Chain(df.select(label, *cols))
    chain.add(VectorAssembler(inputCols=list(cols), outputCol="__x"))
    chain.add(KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__cluster"))
    margin = MappedMargin(inputCol="__x", cluster="__cluster", width=width, degree=degree, waves=waves)
    plain = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    base = materialize(chain.df.select(F.col("__cluster").alias("cluster"), (2 * _binary(label) - 1).alias("y"), *plain), "mapped")
    centers = len(chain.stages[-1].clusterCenters())  # fewer than k where fewer points differ
    weights, offset = mapped_svm(base, margin.map(), width, centers, reg, max_iter)
    discard(base)
    chain.add(margin._set(weights=weights.tolist(), offset=offset))
    return chain.finish()


def gated_experts(
    df: DataFrame,
    cols: list[str],
    m: int = 10,
    hidden: int = 10,
    rounds: int = 3,
    seed: int = 2016,
    label: str = "target",
    key: str = "id",
    reg: float = 0.01,
    max_iter: int = 30,
) -> PipelineModel:
    """Mixture of ``m`` linear SVM experts behind a net that weighs them.

    Per round: fit all experts at once (one SVM over expert blocks, whose
    weights do not interact), find the best expert of every row, fit the gate
    to it, and give each row to the expert its gate prefers.
    """
    keys = [] if key in cols else [key]
    one = SQLTransformer(statement="SELECT *, 1.0D AS __one FROM __THIS__")
    x = VectorAssembler(inputCols=list(cols), outputCol="__x")
    x1 = VectorAssembler(inputCols=[*cols, "__one"], outputCol="__x1")
    rows = x1.transform(x.transform(one.transform(df.select(*keys, label, *cols))))
    base = materialize(rows.select(F.col(key).alias("__key"), label, "__x", "__x1"), "experts")
    # a stored vector column has no size metadata; the interaction needs it
    sized = VectorSizeHint(inputCol="__x1", size=len(cols) + 1, handleInvalid="error").transform(base)
    sized = VectorAssembler(inputCols=["__x1"], outputCol="__xe").transform(sized)

    experts = df.sparkSession.range(m).select(F.col("id").cast("double").alias("__expert"))
    encoder = OneHotEncoder(inputCol="__expert", outputCol="__hot", dropLast=False).fit(experts)
    cross = Interaction(inputCols=["__hot", "__xe"], outputCol="__blocks")
    svm = LinearSVC(featuresCol="__blocks", labelCol=label, regParam=reg, maxIter=max_iter, fitIntercept=False)

    start = F.pmod(F.xxhash64(F.col("__key"), F.lit(seed)), F.lit(m)).cast("double")
    assigned = sized.withColumn("__expert", start)
    for r in range(rounds):
        blocks = cross.transform(encoder.transform(assigned)).select(label, "__blocks")
        weights = svm.fit(blocks).coefficients.toArray().reshape(m, len(cols) + 1)
        margins = MatrixProjection(
            inputCol="__x1", outputCol="__margins", weights=weights.tolist(), offsets=[0.0] * m
        )
        best = margins.transform(sized).select("__x", _best_expert(label).alias("__best"))
        gate = MultilayerPerceptronClassifier(
            featuresCol="__x",
            labelCol="__best",
            layers=[len(cols), hidden, m],
            maxIter=max_iter,
            seed=seed + r,
            predictionCol="__expert",
            probabilityCol="__gate",
            rawPredictionCol="__graw",
        ).fit(best)
        assigned = gate.transform(sized).drop("__gate", "__graw")
    mix = GatedMargin(inputCols=["__gate", "__margins"], outputCol="probability")
    tidy = SQLTransformer(statement="SELECT * EXCEPT (__one, __x, __x1, __graw, __expert) FROM __THIS__")
    return PipelineModel([one, x, x1, gate, margins, mix, tidy])


def _best_expert(label: str) -> Column:
    """Number of the expert whose margin fits the label of the row best."""
    margins = vector_to_array(F.col("__margins"))
    fit = F.when(F.col(label) == 1, margins).otherwise(F.transform(margins, lambda v: -v))
    return (F.array_position(fit, F.array_max(fit)) - 1).cast("double")
