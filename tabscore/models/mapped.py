"""Linear SVM on a feature map that is never stored.

One SVM has weights that all rows share and weights of each row's cluster, all of
mapped features ``m(x)``:

    margin = m(x) (u + w_cluster) + b

What is fitted is the mean hinge loss plus an L2 penalty of the standardized weights, as
Spark ML's ``LinearSVC`` fits it on the vector ``[m(x), onehot(cluster) (x) m(x)]``. That keeps
this vector of every row, in blocks that go to disk where memory ends; here the rows keep their
plain features, and each pass maps them anew, batch by batch. A task sends one sum of
mapped features for each cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.models.net import BLOCK_SCHEMA
from tabscore.operators.arrays import add_vectors, in_blocks


class Monomials:
    """All products of up to ``degree`` features."""

    def __init__(self, width: int, degree: int):
        self.steps, last = [], np.arange(width)  # the last factor of each product of a degree
        self.size = width
        for _ in range(degree - 1):
            before = np.concatenate([np.full(width - j, i) for i, j in enumerate(last)])
            factor = np.concatenate([np.arange(j, width) for j in last])
            self.steps.append((before, factor))
            self.size, last = self.size + len(factor), factor

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = [x]
        for before, factor in self.steps:
            parts.append(parts[-1][:, before] * x[:, factor])
        return np.concatenate(parts, axis=1)


@dataclass
class Waves:
    """Random Fourier features: scaled cosines of ``W x + b``."""

    weights: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.size) * np.cos(x @ self.weights.T + self.offsets)


class MappedMargin(Transformer, HasInputCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class by the sign of the margin of a row's cluster."""

    cluster = Param(Params._dummy(), "cluster", "column of cluster numbers", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of plain features", TypeConverters.toInt)
    degree = Param(Params._dummy(), "degree", "of the monomials; 0 for random Fourier features", TypeConverters.toInt)
    waves = Param(Params._dummy(), "waves", "weights and offset of each Fourier feature", TypeConverters.toListListFloat)
    weights = Param(Params._dummy(), "weights", "weights of each cluster", TypeConverters.toListListFloat)
    offset = Param(Params._dummy(), "offset", "added to every margin", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, cluster=None, width=None, degree=None, waves=None, weights=None, offset=None):
        super().__init__()
        self._setDefault(waves=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def map(self) -> Callable[[np.ndarray], np.ndarray]:
        if degree := self.getOrDefault(self.degree):
            return Monomials(self.getOrDefault(self.width), degree)
        waves = np.asarray(self.getOrDefault(self.waves), dtype=float)
        return Waves(waves[:, :-1], waves[:, -1])

    def _transform(self, df: DataFrame) -> DataFrame:
        mapped, width = self.map(), self.getOrDefault(self.width)
        weights, offset = np.asarray(self.getOrDefault(self.weights), dtype=float), self.getOrDefault(self.offset)

        @F.pandas_udf("double")
        def margins(x: pd.Series, cluster: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            of_all = mapped(np.stack(x.to_numpy()).reshape(-1, width)) @ weights.T
            return pd.Series(of_all[np.arange(len(x)), cluster.to_numpy()] + offset)

        margin = margins(vector_to_array(F.col(self.getInputCol())), F.col(self.getOrDefault(self.cluster)))
        return df.withColumn(self.getPredictionCol(), F.when(margin > 0, 1.0).otherwise(0.0))


def _summed(base: DataFrame, width: int, length: int, add: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``add(x, y, cluster)`` has for a batch of them, a vector of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if len(batch):
                x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(width)])
                total += add(x, batch.column("y").to_numpy(), batch.column("cluster").to_numpy())
        yield in_blocks({"net": 0}, TaskContext.get().partitionId(), total)

    return add_vectors(base.mapInArrow(run, BLOCK_SCHEMA), ["net"], length)[(0,)]


def _by_cluster(values: np.ndarray, cluster: np.ndarray, k: int, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """One row for each cluster: the weighted sum of its rows."""
    return ((cluster[:, None] == np.arange(k)).T * weight) @ values


def minimize(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tol: float = 1e-6, memory: int = 10) -> np.ndarray:
    """L-BFGS with a line search for the weak Wolfe conditions; ``loss`` gives value and gradient."""
    x, (f, g) = start, loss(start)
    first, pairs = f, []
    for _ in range(rounds):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        way, taken = -g, []
        for s, d in reversed(pairs):
            taken.append((s @ way) / (s @ d))
            way = way - taken[-1] * d
        if pairs:
            s, d = pairs[-1]
            way = way * ((s @ d) / (d @ d))
        for (s, d), part in zip(pairs, reversed(taken)):
            way = way + (part - (d @ way) / (s @ d)) * s
        slope = g @ way
        step, low, high, best = 1.0 if pairs else 1.0 / np.linalg.norm(g), 0.0, np.inf, None
        for _ in range(20):
            new = x + step * way
            value, grad = loss(new)
            if value > f + 1e-4 * step * slope:
                high = step
            else:
                if best is None or value < best[1]:
                    best = new, value, grad
                if grad @ way >= 0.9 * slope:
                    break
                low = step
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if best is None:  # no step gains
            break
        new, value, grad = best
        s, d = new - x, grad - g
        if s @ d > 1e-12 * (d @ d):
            pairs = [*pairs, (s, d)][-memory:]
        gain, x, f, g = f - value, new, value, grad
        if gain <= tol * abs(first):
            break
    return x


def mapped_svm(base: DataFrame, mapped, width: int, k: int, reg: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of each of ``k`` clusters, the shared ones included, and the offset.

    ``base`` is stored and has ``x0``, ``x1``, ... (numbers), ``y`` (-1 or 1) and ``cluster``.
    """
    m = mapped.size

    def add_means(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _by_cluster(np.hstack([mapped(x), np.ones((len(x), 1))]), c, k).ravel()

    sums = _summed(base, width, k * (m + 1), add_means).reshape(k, m + 1)
    counts, n = sums[:, -1], sums[:, -1].sum()
    own = sums[:, :-1] / n
    shared = own.sum(0)

    def add_squares(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = mapped(x)
        return np.concatenate([((v - shared) ** 2).sum(0), _by_cluster((v - own[c]) ** 2, c, k).ravel()])

    squares = _summed(base, width, (k + 1) * m, add_squares).reshape(k + 1, m)
    means = np.vstack([shared, own])
    # a mapped feature of a cluster is 0 in the rows of the others
    squares[1:] += (n - counts)[:, None] * own**2
    spread = squares / max(n - 1, 1)
    varies = spread > 1e-22 * means**2  # else it is rounding
    inverse = np.divide(1.0, np.sqrt(spread), out=np.zeros_like(spread), where=varies)
    centre = means * inverse  # of the standardized features, the shared ones first

    def effective(flat: np.ndarray) -> tuple[np.ndarray, float]:
        w = flat[:-1].reshape(k + 1, m)
        scaled = w * inverse
        return scaled[0] + scaled[1:], float(flat[-1] - (w * centre).sum())

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        weights, offset = effective(flat)

        def add(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
            v = mapped(x)
            lack = 1 - y * ((v @ weights.T)[np.arange(len(y)), c] + offset)
            pull = np.where(lack > 0, -y, 0.0)
            return np.concatenate([[np.maximum(lack, 0).sum(), pull.sum()], _by_cluster(v, c, k, pull).ravel()])

        found = _summed(base, width, 2 + k * m, add) / n
        pulled = found[2:].reshape(k, m)
        w = flat[:-1].reshape(k + 1, m)
        grad = np.vstack([pulled.sum(0), pulled]) * inverse - centre * found[1] + reg * w
        return float(found[0] + 0.5 * reg * (w * w).sum()), np.append(grad.ravel(), found[1])

    return effective(minimize(loss, np.zeros((k + 1) * m + 1), rounds))
