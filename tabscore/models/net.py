"""Feed-forward nets with dropout, trained by gradients or by averaged copies.

Two ways to spread one training over tasks:

- ``spread="gradient"``: mini-batch gradient steps. The rows are dealt into batches
  once; every step, tasks add up the gradient of their rows of one batch, the sum
  moves the weights, and the next step gets the new ones. One epoch reads every
  batch once.
- ``spread="average"``: in each pass every task trains its own copy of the weights
  on its rows, in small batches, and the copies are averaged by their rows.
  One pass is one epoch, whatever the number of tasks.

Several settings train in one pass over the rows (``NetTrainer``). Random choices
(dropout, start weights, batches) follow from the seed and the rows' keys, not
from tasks or the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.operators.arrays import add_vectors, hashed, in_blocks
from tabscore.operators.metrics import _binary
from tabscore.sources.scratch import materialize, release

ACTIVATIONS = ("rectifier", "tanh", "maxout")
PIECES = 2  # linear pieces of a maxout unit


@dataclass(frozen=True)
class NetSettings:
    """One net and how it learns.

    Dropout ratios are the parts of the inputs (of a hidden layer's units) that a
    row leaves out; ``hidden_dropout`` has one for each layer. ``adaptive`` steps by
    ADADELTA (``rho``, ``epsilon``), else by ``rate`` (divided by 1 + annealing * rows
    seen) with ``momentum``, looked ahead with ``nesterov``. ``l1`` and ``l2`` act on weights, not
    offsets; ``max_w2`` bounds the squared incoming weights of a unit. ``batch`` counts
    rows: of a task's copy in averaging, of a whole step otherwise.
    """

    hidden: tuple[int, ...] = (32,)
    activation: str = "rectifier"
    input_dropout: float = 0.0
    hidden_dropout: tuple[float, ...] = ()
    l1: float = 0.0
    l2: float = 0.0
    max_w2: float = float("inf")
    adaptive: bool = True
    rho: float = 0.99
    epsilon: float = 1e-6
    rate: float = 0.05
    annealing: float = 0.0
    momentum: float = 0.0
    nesterov: bool = True
    batch: int = 32
    seed: int = 2016

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")
        if self.hidden_dropout and len(self.hidden_dropout) != len(self.hidden):
            raise ValueError("hidden_dropout needs one ratio for each hidden layer")
        if not all(0 <= r < 1 for r in (self.input_dropout, *self.hidden_dropout)):
            raise ValueError("a dropout ratio is at least 0 and less than 1")

    def ratios(self) -> tuple[float, ...]:
        return (self.input_dropout, *(self.hidden_dropout or (0.0,) * len(self.hidden)))


@dataclass(frozen=True)
class Layers:
    """The arithmetic of a net whose weights are one long vector."""

    inputs: int
    hidden: tuple[int, ...]
    activation: str

    @property
    def shapes(self) -> list[tuple[int, int]]:
        """Rows (linear pieces) and columns (inputs) of each layer."""
        pieces = PIECES if self.activation == "maxout" else 1
        widths = [self.inputs, *self.hidden]
        return [(pieces * b, a) for a, b in zip(widths, self.hidden)] + [(1, widths[-1])]

    @property
    def size(self) -> int:
        return sum(a * b + a for a, b in self.shapes)

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the weights and offsets of each layer."""
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + a]))
            at += a * b + a
        return out

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights whose spread fits the layer's widths; offsets 0, or 0.5 for rectifiers."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for i, (w, b) in enumerate(self.parts(flat)):
            reach = np.sqrt(6.0 / sum(w.shape))
            w[:] = rng.uniform(-reach, reach, w.shape)
            b[:] = 0.5 if self.activation == "rectifier" and i < len(self.hidden) else 0.0
        return flat

    def _unit(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the units, and the slope of each linear piece."""
        if self.activation == "tanh":
            a = np.tanh(z)
            return a, 1 - a * a
        if self.activation == "rectifier":
            return np.maximum(z, 0.0), (z > 0).astype(float)
        pieces = z.reshape(len(z), -1, PIECES)
        best = pieces.argmax(2)
        a = np.take_along_axis(pieces, best[:, :, None], 2)[:, :, 0]
        return a, (best[:, :, None] == np.arange(PIECES)).astype(float).reshape(z.shape)

    def margin(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1, no input or unit left out."""
        *inner, (w, b) = self.parts(flat)
        for v, c in inner:
            x, _ = self._unit(x @ v.T + c)
        return (x @ w.T + b)[:, 0]

    def gradient(
        self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, masks: list[np.ndarray | None]
    ) -> tuple[float, np.ndarray]:
        """Sum over the rows of the logistic loss, and its gradient."""
        parts, grad = self.parts(flat), np.zeros_like(flat)
        a, slopes, inputs = x, [], []
        for (w, b), mask in zip(parts[:-1], masks[:-1], strict=True):
            a = a if mask is None else a * mask
            inputs.append(a)
            a, slope = self._unit(a @ w.T + b)
            slopes.append(slope)
        a = a if masks[-1] is None else a * masks[-1]
        inputs.append(a)
        z = (a @ parts[-1][0].T + parts[-1][1])[:, 0]
        loss = float(np.sum(np.logaddexp(0.0, z) - y * z))
        back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)[:, None]
        for i in range(len(parts) - 1, -1, -1):
            (w, _), (gw, gb) = parts[i], self.parts(grad)[i]
            gw[:], gb[:] = back.T @ inputs[i], back.sum(0)
            if i:
                back = back @ w
                if masks[i] is not None:
                    back = back * masks[i]
                if self.activation == "maxout":
                    back = np.repeat(back, PIECES, 1)
                back = back * slopes[i - 1]
        return loss, grad


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def dropout_masks(settings: NetSettings, inputs: int, keys: np.ndarray, epoch: int) -> list[np.ndarray | None]:
    """What each row (by its 64-bit key) leaves out in an epoch: 0, or 1 over the part that stays."""
    masks = []
    for layer, (width, ratio) in enumerate(zip((inputs, *settings.hidden), settings.ratios(), strict=True)):
        if not ratio:
            masks.append(None)
            continue
        unit = np.arange(width, dtype=np.uint64) + np.uint64(layer << 32) + np.uint64(1)
        salt = _scramble(unit * np.uint64(0x9E3779B97F4A7C15) + np.uint64(settings.seed * 1_000_003 + epoch))
        draw = _scramble(keys.view(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)
        masks.append((draw.astype(float) * 2.0**-53 >= ratio) / (1 - ratio))
    return masks


@dataclass
class NetState:
    """Weights, two running vectors of the step rule, and the rows seen so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rows: float = 0.0

    @staticmethod
    def start(settings: NetSettings, inputs: int) -> NetState:
        layers = Layers(inputs, settings.hidden, settings.activation)
        return NetState(layers.start(settings.seed), np.zeros(layers.size), np.zeros(layers.size))

    def copy(self) -> NetState:
        return NetState(self.weights.copy(), self.first.copy(), self.second.copy(), self.rows)


@lru_cache(maxsize=64)
def _decays(layers: Layers) -> np.ndarray:
    """1 for weights, 0 for offsets."""
    flat = np.zeros(layers.size)
    for w, _ in layers.parts(flat):
        w[:] = 1.0
    return flat


def step(settings: NetSettings, layers: Layers, state: NetState, gradient: np.ndarray, rows: float) -> None:
    """Move the weights by the mean gradient of ``rows`` rows."""
    decays = _decays(layers)
    w = state.weights
    g = gradient + decays * (settings.l1 * np.sign(w) + 2 * settings.l2 * w)
    if settings.adaptive:
        state.first *= settings.rho
        state.first += (1 - settings.rho) * g * g
        move = -np.sqrt(state.second + settings.epsilon) / np.sqrt(state.first + settings.epsilon) * g
        state.second *= settings.rho
        state.second += (1 - settings.rho) * move * move
    else:
        rate = settings.rate / (1 + settings.annealing * state.rows)
        state.first *= settings.momentum
        state.first -= rate * g
        move = settings.momentum * state.first - rate * g if settings.nesterov else state.first
    w += move
    if np.isfinite(settings.max_w2):
        for v, _ in layers.parts(w):
            square = (v * v).sum(1, keepdims=True)
            v *= np.sqrt(np.minimum(1.0, settings.max_w2 / np.maximum(square, 1e-300)))
    state.rows += rows


def _columns(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
    return batch.column("__k").to_numpy(), batch.column("__y").to_numpy(), x


def _regroup(batches: Iterator[pa.RecordBatch], inputs: int, rows: int) -> Iterator[tuple]:
    """Rows in groups of ``rows``, wherever the Arrow batches end."""
    kept: list[tuple] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(_columns(batch, inputs))
        n += len(batch)
        if n >= rows:
            k, y, x = (np.concatenate(c) for c in zip(*kept, strict=True))
            whole = n - n % rows
            for i in range(0, whole, rows):
                yield k[i : i + rows], y[i : i + rows], x[i : i + rows]
            kept, n = ([(k[whole:], y[whole:], x[whole:])], n - whole) if n > whole else ([], 0)
    if n:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def learn_rows(
    settings: NetSettings, inputs: int, state: NetState, groups: Iterator[tuple], epoch: int
) -> NetState:
    """Plain training: one step for each group of rows, in order."""
    layers = Layers(inputs, settings.hidden, settings.activation)
    for keys, y, x in groups:
        masks = dropout_masks(settings, inputs, keys, epoch)
        _, grad = layers.gradient(state.weights, x, y, masks)
        step(settings, layers, state, grad / len(y), len(y))
    return state


def _learn_copies(settings: list[NetSettings], inputs: int, states: list[NetState], epoch: int):
    """Each task trains a copy of every net on its rows and sends weights and step vectors times its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        least = np.gcd.reduce([s.batch for s in settings])
        copies = [s.copy() for s in states]
        before = [s.rows for s in copies]
        waiting: list[list] = [[] for _ in settings]
        for group in _regroup(batches, inputs, int(least)):
            for i, s in enumerate(settings):
                waiting[i].append(group)
                if sum(len(g[0]) for g in waiting[i]) >= s.batch:
                    whole = tuple(np.concatenate(c) for c in zip(*waiting[i], strict=True))
                    learn_rows(s, inputs, copies[i], iter([whole]), epoch)
                    waiting[i] = []
        for i, s in enumerate(settings):
            if waiting[i]:
                whole = tuple(np.concatenate(c) for c in zip(*waiting[i], strict=True))
                learn_rows(s, inputs, copies[i], iter([whole]), epoch)
            seen = copies[i].rows - before[i]
            if seen:
                vector = np.concatenate([copies[i].weights, copies[i].first, copies[i].second]) * seen
                yield in_blocks({"net": i}, part, np.concatenate([[seen], vector]))

    return run


def _add_gradients(settings: NetSettings, inputs: int, state: NetState, epoch: int):
    """Of each task's rows, their number, the loss and the gradient."""
    layers = Layers(inputs, settings.hidden, settings.activation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros(layers.size)
        for keys, y, x in _regroup(batches, inputs, 1024):
            own, grad = layers.gradient(state.weights, x, y, dropout_masks(settings, inputs, keys, epoch))
            n, loss, total = n + len(y), loss + own, total + grad
        if n:
            yield in_blocks({"net": 0}, TaskContext.get().partitionId(), np.concatenate([[n, loss], total]))

    return run


BLOCK_SCHEMA = "net int, block int, part int, values array<double>"


@dataclass
class NetTrainer:
    """Rows prepared for training, and passes over them.

    ``tasks`` deals the rows into so many parts for averaging (default: the session's
    number of shuffle partitions); ``batches`` into so many for gradient steps. Keys
    are unique; a feature that is NULL or NaN raises.
    """

    df: DataFrame
    cols: list[str]
    label: str = "target"
    key: str = "id"
    seed: int = 2016
    tasks: int | None = None
    batches: int = 1
    rows: DataFrame = field(init=False)

    def __post_init__(self):
        def feature(c: str):
            x = F.col(c).cast("double")
            lacking = F.raise_error(F.lit(f"{c} is NULL or NaN")).cast("double")
            return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(lacking)

        rows = self.df.select(
            hashed(self.key, self.seed).alias("__k"),
            _binary(self.label).alias("__y"),
            F.array(*[feature(c) for c in self.cols]).alias("__x"),
        ).withColumn("__batch", F.pmod(F.col("__k"), F.lit(self.batches)).cast("int"))
        dealt = rows.repartition(self.tasks, "__k") if self.tasks else rows.repartition("__k")
        self.rows = materialize(dealt.sortWithinPartitions("__batch", "__k"), "net")

    @property
    def inputs(self) -> int:
        return len(self.cols)

    def average(self, settings: list[NetSettings], states: list[NetState], epoch: int) -> list[NetState]:
        """One pass of all nets: every task trains copies, which are averaged by rows."""
        trained = self.rows.select("__k", "__y", "__x").mapInArrow(
            _learn_copies(settings, self.inputs, states, epoch), BLOCK_SCHEMA
        )
        sizes = {(i,): 3 * len(s.weights) + 1 for i, s in enumerate(states)}
        out = []
        for i, total in sorted(add_vectors(trained, ["net"], sizes).items()):
            w, first, second = np.split(total[1:] / total[0], 3)
            out.append(NetState(w.copy(), first.copy(), second.copy(), states[i[0]].rows + total[0]))
        return out or states

    def descend(self, settings: NetSettings, state: NetState, epoch: int, batch: int) -> NetState:
        """One step by the gradient of one batch of rows."""
        rows = self.rows.filter(F.col("__batch") == batch) if self.batches > 1 else self.rows
        parts = rows.select("__k", "__y", "__x").mapInArrow(
            _add_gradients(settings, self.inputs, state, epoch), BLOCK_SCHEMA
        )
        total = add_vectors(parts, ["net"], len(state.weights) + 2).get((0,))
        state = state.copy()
        if total is not None:
            layers = Layers(self.inputs, settings.hidden, settings.activation)
            step(settings, layers, state, total[2:] / total[0], total[0])
        return state

    def close(self) -> None:
        release(self.rows)


class NetModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability of class 1 of a trained net, from a vector column."""

    weights = Param(Params._dummy(), "weights", "all weights and offsets", TypeConverters.toListFloat)
    hidden = Param(Params._dummy(), "hidden", "units of each hidden layer", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "kind of the hidden units", TypeConverters.toString)
    inputs = Param(Params._dummy(), "inputs", "number of inputs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, hidden=None, activation=None, inputs=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def layers(self) -> Layers:
        return Layers(
            self.getOrDefault(self.inputs), tuple(self.getOrDefault(self.hidden)), self.getOrDefault(self.activation)
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        layers, flat = self.layers(), np.array(self.getOrDefault(self.weights))

        @F.pandas_udf("double")
        def p1(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(1 / (1 + np.exp(-np.clip(layers.margin(flat, np.stack(x.to_numpy())), -500, 500))))

        out = df.withColumn("__p1", p1(vector_to_array(F.col(self.getInputCol()))))
        vector = array_to_vector(F.array(1 - F.col("__p1"), F.col("__p1")))
        label = F.when(F.col("__p1") > 0.5, 1.0).otherwise(0.0)
        return out.withColumns({self.getOutputCol(): vector, "prediction": label}).drop("__p1")


def net_model(settings: NetSettings, state: NetState, cols: list[str]) -> PipelineModel:
    """A trained net as a pipeline that scores ``cols``."""
    stage = NetModel(
        inputCol="features",
        outputCol="probability",
        weights=state.weights.tolist(),
        hidden=list(settings.hidden),
        activation=settings.activation,
        inputs=len(cols),
    )
    return PipelineModel([VectorAssembler(inputCols=list(cols), outputCol="features"), stage])


def train_net(
    trainer: NetTrainer,
    settings: NetSettings,
    epochs: float,
    spread: str = "average",
    state: NetState | None = None,
    first_epoch: int = 0,
) -> NetState:
    """``epochs`` of training, from ``state`` or from the start.

    Averaging takes whole epochs (one pass each, at least one); gradient steps
    take a part of the last epoch's batches.
    """
    state = state or NetState.start(settings, trainer.inputs)
    if spread == "average":
        for e in range(max(1, round(epochs))):
            (state,) = trainer.average([settings], [state], first_epoch + e)
        return state
    if spread != "gradient":
        raise ValueError(f"unknown spread {spread!r}")
    order = np.random.default_rng(settings.seed)
    for i in range(max(1, round(epochs * trainer.batches))):
        epoch, at = divmod(i, trainer.batches)
        if at == 0:
            batches = order.permutation(trainer.batches)
        state = trainer.descend(settings, state, first_epoch + epoch, int(batches[at]))
    return state


def net(
    df: DataFrame,
    cols: list[str],
    hidden: tuple[int, ...] | list[int],
    epochs: float = 10.0,
    spread: str = "average",
    label: str = "target",
    key: str = "id",
    tasks: int | None = None,
    **settings,
) -> PipelineModel:
    """A net with rectifier, tanh or maxout units, dropout, L1 and L2; see ``NetSettings`` and the module.

    Features should be scaled. With ``spread='gradient'``, ``batch`` rows make one step.
    """
    chosen = NetSettings(hidden=tuple(hidden), **settings)
    batches = max(1, round(df.count() / chosen.batch)) if spread == "gradient" else 1
    trainer = NetTrainer(df, list(cols), label, key, chosen.seed, tasks, batches)
    try:
        return net_model(chosen, train_net(trainer, chosen, epochs, spread), cols)
    finally:
        trainer.close()


def net_importance(model: PipelineModel) -> DataFrame:
    """``feature, share`` by weights: what part of each unit's absolute input weights comes from a feature, through all layers."""
    stage, assembler = model.stages[-1], model.stages[0]
    layers = stage.layers()
    flow = np.eye(layers.inputs)
    for w, _ in layers.parts(np.array(stage.getOrDefault(stage.weights))):
        size = np.abs(w)
        if layers.activation == "maxout" and len(w) > 1:
            size = size.reshape(-1, PIECES, w.shape[1]).sum(1)
        total = size.sum(1, keepdims=True)
        flow = np.divide(size, total, out=np.zeros_like(size), where=total > 0) @ flow
    share = flow[0] / max(flow[0].sum(), 1e-300)
    rows = list(zip(assembler.getInputCols(), share.tolist()))
    frame = SparkSession.active().createDataFrame(rows, "feature string, share double")
    return frame.orderBy(F.desc("share"), "feature")


def scored_rows(
    valid: DataFrame, cols: list[str], label: str, nets: dict[str, tuple[NetSettings, NetState]]
) -> DataFrame:
    """``model_id, label, score``: the rows under every net, in one scan."""
    names = list(nets)
    models = [(Layers(len(cols), s.hidden, s.activation), state.weights) for s, state in nets.values()]
    rows = valid.select(F.col(label).alias("__y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("__x"))

    @F.pandas_udf("array<double>")
    def margins(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        matrix = np.stack(x.to_numpy())
        return pd.Series(list(np.column_stack([layers.margin(w, matrix) for layers, w in models])))

    each = rows.select("__y", F.posexplode(margins("__x")).alias("__at", "score"))
    model_id = F.get(F.array(*[F.lit(n) for n in names]), F.col("__at"))
    return each.select(model_id.alias("model_id"), F.col("__y").alias(label), "score")


def with_options(settings: NetSettings, options: dict) -> NetSettings:
    """Settings with some fields replaced; lists become tuples."""
    return replace(settings, **{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})
