"""Mixture of linear SVM experts of equal size behind a trained gate.

Rows are dealt to experts in equal numbers. Per round all experts are fitted at
once, a net that weighs them (the gate) is trained by the loss of the mixture

    log(1 + exp(-y * sum_e p_e(x) s_e(x))),  p = softmax of the gate, s = margins of the experts

and the rows are dealt anew, each expert getting its share of those that the gate
would send to it. Rounds stop when the loss no longer falls by ``threshold`` of itself;
the round before is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.models.net import BLOCK_SCHEMA, NetSettings, NetState, step
from tabscore.operators.arrays import add_vectors, hashed, in_blocks
from tabscore.operators.metrics import _binary
from tabscore.operators.profile import select_ranks
from tabscore.sources.scratch import materialize, release


def balanced_assign(rows: DataFrame, experts: int) -> DataFrame:
    """``rows`` (with ``id`` and ``w``, one weight for each expert) and ``expert``, in equal numbers.

    Expert numbers begin at 0; the first take one row more where the rows don't
    divide. In each round a row asks for the expert of its greatest weight among
    those with room; one that is asked by more rows than it has room for takes those
    of the greatest weight (ties by ``id``, which is unique). The cut is found by
    counting, so no row is moved or sorted. A round fills an expert or is the last.
    """
    n = rows.count()
    room = [n // experts + (e < n % experts) for e in range(experts)]
    state = materialize(rows.withColumn("expert", F.lit(None).cast("int")), "experts")
    # a total order of rows: weight, then the two parts of the id, each exact as a double
    order = [F.col("__weight"), F.shiftright("id", 11).cast("double"), F.pmod("id", F.lit(2048)).cast("double")]
    while sum(room):
        open_ = [e for e in range(experts) if room[e]]
        wish = F.array_max(F.array(*[F.struct(F.get("w", F.lit(e)).alias("__weight"), F.lit(-e).alias("e")) for e in open_]))
        asked = state.withColumn("__wish", F.when(F.col("expert").isNull(), wish))
        asked = asked.select("*", (-F.col("__wish.e")).alias("__asked"), F.col("__wish.__weight").alias("__weight"))
        # what has a greater place than the cut is taken, what has the same goes on to the next part of the order
        counts = {r["__asked"]: r["n"] for r in asked.filter("__asked is not null").groupBy("__asked").agg(F.count("*").alias("n")).collect()}
        taken = F.lit(False)
        wanted = {e: room[e] for e, c in counts.items() if c > room[e]}
        for e, c in counts.items():
            if e not in wanted:
                taken = taken | (F.col("__asked") == e)
        tied, left = {e: F.col("__asked") == e for e in wanted}, dict(wanted)
        for value in order:
            if not left:
                break
            name = F.coalesce(*[F.when(tied[e], F.lit(str(e))) for e in left])
            values = asked.select(name.alias("variable"), value.alias("value")).filter("variable is not null")
            totals = values.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).collect()
            ends = {r["variable"]: (r["lo"], r["hi"], r["n"]) for r in totals}
            cuts = select_ranks(values, ends, {str(e): {ends[str(e)][2] - left[e] + 1} for e in left})
            cut_at = {int(v): t for (v, _), t in cuts.items()}
            above = values.join(
                F.broadcast(rows.sparkSession.createDataFrame([(str(e), t) for e, t in cut_at.items()], "variable string, cut double")), "variable"
            )
            above = above.groupBy("variable").agg(
                F.count_if(F.col("value") > F.col("cut")).alias("over"), F.count_if(F.col("value") == F.col("cut")).alias("same")
            )
            for r in above.collect():  # one row for each expert
                e = int(r["variable"])
                taken = taken | (tied[e] & (value > F.lit(cut_at[e])))
                tied[e] = tied[e] & (value == F.lit(cut_at[e]))
                left[e] -= r["over"]
                if left[e] == r["same"]:
                    taken, left[e] = taken | tied[e], 0
            left = {e: c for e, c in left.items() if c}
        new = asked.withColumn("expert", F.when(taken, F.col("__asked")).otherwise(F.col("expert")))
        before, state = state, materialize(new.select(*rows.columns, "expert"), "experts")
        state.count()
        release(before)
        for e, c in counts.items():
            room[e] -= min(c, room[e])
    return state


@dataclass(frozen=True)
class Gate:
    """A net of one tanh layer whose outputs are the experts' weights."""

    inputs: int
    hidden: int
    experts: int

    @property
    def size(self) -> int:
        return self.hidden * (self.inputs + 1) + self.experts * (self.hidden + 1)

    def parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in ((self.hidden, self.inputs), (self.experts, self.hidden)):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + a]))
            at += a * b + a
        return out

    def start(self, seed: int) -> np.ndarray:
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for w, _ in self.parts(flat):
            w[:] = rng.uniform(-1, 1, w.shape) * np.sqrt(6 / sum(w.shape))
        return flat

    def weights(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        (v, c), (w, b) = self.parts(flat)
        z = np.tanh(x @ v.T + c) @ w.T + b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, margins: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum over rows of the mixture's loss (y is -1 or 1), and its gradient."""
        (v, c), (w, b) = self.parts(flat)
        a = np.tanh(x @ v.T + c)
        z = a @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mix = (p * margins).sum(1)
        loss = float(np.logaddexp(0, -y * mix).sum())
        pull = -y / (1 + np.exp(np.clip(y * mix, -500, 500)))  # by the mixture
        back = pull[:, None] * p * (margins - mix[:, None])  # by the outputs
        grad = np.zeros_like(flat)
        (gv, gc), (gw, gb) = self.parts(grad)
        gw[:], gb[:] = back.T @ a, back.sum(0)
        inner = (back @ w) * (1 - a * a)
        gv[:], gc[:] = inner.T @ x, inner.sum(0)
        return loss, grad


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("y").to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _train_gate(gate: Gate, settings: NetSettings, state: NetState, experts: np.ndarray):
    """Each task trains a copy of the gate on its rows and sends it, times its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy, n = state.copy(), 0
        for batch in batches:
            for part in (batch.slice(i, settings.batch) for i in range(0, len(batch), settings.batch)):
                y, x = _columns(part, gate.inputs)
                _, grad = gate.gradient(copy.weights, x, y, x @ experts[:, :-1].T + experts[:, -1])
                step(settings, gate, copy, grad / len(y), len(y))
                n += len(y)
        if n:
            vector = np.concatenate([copy.weights, copy.first, copy.second]) * n
            yield in_blocks({"net": 0}, TaskContext.get().partitionId(), np.concatenate([[n], vector]))

    return run


def _add_losses(gate: Gate, flat: np.ndarray, experts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss = 0, 0.0
        for batch in batches:
            y, x = _columns(batch, gate.inputs)
            own, _ = gate.gradient(flat, x, y, x @ experts[:, :-1].T + experts[:, -1])
            n, loss = n + len(y), loss + own
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss])], ["n", "loss"])

    return run


def _gate_weights(gate: Gate, flat: np.ndarray):
    @F.pandas_udf("array<double>")
    def weigh(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(gate.weights(flat, np.stack(x.to_numpy()).reshape(-1, gate.inputs))))

    return weigh


class GatedModel(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability of class 1 of a gated mixture."""

    experts = Param(Params._dummy(), "experts", "weights and offset of each expert", TypeConverters.toListListFloat)
    gate = Param(Params._dummy(), "gate", "weights of the gate", TypeConverters.toListFloat)
    hidden = Param(Params._dummy(), "hidden", "units of the gate", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="probability", experts=None, gate=None, hidden=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        experts, flat = np.array(self.getOrDefault(self.experts)), np.array(self.getOrDefault(self.gate))
        gate = Gate(len(self.getInputCols()), self.getOrDefault(self.hidden), len(experts))

        @F.pandas_udf("double")
        def mixed(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            matrix = np.stack(x.to_numpy()).reshape(-1, gate.inputs)
            return pd.Series((gate.weights(flat, matrix) * (matrix @ experts[:, :-1].T + experts[:, -1])).sum(1))

        out = df.withColumn("__m", mixed(F.array(*[F.col(c).cast("double") for c in self.getInputCols()])))
        p1 = 1 / (1 + F.exp(-F.col("__m")))
        label = F.when(F.col("__m") > 0, 1.0).otherwise(0.0)
        return out.withColumns({self.getOutputCol(): array_to_vector(F.array(1 - p1, p1)), "prediction": label}).drop("__m")


def _fit_experts(assigned: DataFrame, m: int, width: int, reg: float, max_iter: int) -> np.ndarray:
    """One SVM over expert blocks: their weights do not interact. Rows: expert; columns: features, offset."""
    one = assigned.select(
        ((F.col("y") + 1) / 2).alias("label"), F.col("expert").cast("double").alias("__expert"), array_to_vector(F.concat("x", F.array(F.lit(1.0)))).alias("__x1")
    )
    sized = VectorSizeHint(inputCol="__x1", size=width + 1, handleInvalid="error").transform(one)
    sized = VectorAssembler(inputCols=["__x1"], outputCol="__xe").transform(sized)
    all_experts = assigned.sparkSession.range(m).select(F.col("id").cast("double").alias("__expert"))
    encoder = OneHotEncoder(inputCol="__expert", outputCol="__hot", dropLast=False).fit(all_experts)
    blocks = Interaction(inputCols=["__hot", "__xe"], outputCol="__blocks").transform(encoder.transform(sized))
    svm = LinearSVC(featuresCol="__blocks", labelCol="label", regParam=reg, maxIter=max_iter, fitIntercept=False)
    return svm.fit(blocks.select("label", "__blocks")).coefficients.toArray().reshape(m, width + 1)


def balanced_experts(
    df: DataFrame,
    cols: list[str],
    m: int = 10,
    hidden: int = 10,
    rounds: int = 3,
    threshold: float = 0.0,
    epochs: int = 5,
    reg: float = 0.01,
    max_iter: int = 30,
    seed: int = 2016,
    label: str = "target",
    key: str = "id",
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The model, ``round, loss`` of the rounds kept, and ``id, expert``: who had which row in the last of them.

    Keys are unique and ``id`` hashes them; features should be scaled, and one that is NULL raises.
    """
    lacking = F.raise_error(F.lit("a feature is NULL")).cast("double")
    x = F.array(*[F.coalesce(F.col(c).cast("double"), lacking) for c in cols])
    rows = df.select(hashed(key, seed).alias("id"), (2 * _binary(label) - 1).alias("y"), x.alias("x"))
    base = materialize(rows, "experts")
    width, spark = len(cols), df.sparkSession
    gate, settings = Gate(width, hidden, m), NetSettings((), "tanh", batch=32, seed=seed, rho=0.95, epsilon=1e-5)
    state = NetState(gate.start(seed), np.zeros(gate.size), np.zeros(gate.size))
    draw = F.array(*[F.xxhash64("id", F.lit(seed + e)).cast("double") for e in range(m)])
    assigned = balanced_assign(base.withColumn("w", draw), m)
    kept, history = None, []
    for r in range(1, rounds + 1):
        experts = _fit_experts(assigned, m, width, reg, max_iter)
        for _ in range(epochs):
            sent = base.select("y", "x").mapInArrow(_train_gate(gate, settings, state, experts), BLOCK_SCHEMA)
            total = add_vectors(sent, ["net"], 3 * gate.size + 1).get((0,))
            if total is not None:
                w, first, second = np.split(total[1:] / total[0], 3)
                state = NetState(w.copy(), first.copy(), second.copy(), state.rows + total[0])
        sums = base.select("y", "x").mapInArrow(_add_losses(gate, state.weights, experts), "n long, loss double")
        n, loss = sums.agg(F.sum("n"), F.sum("loss")).first()
        loss = loss / n if n else 0.0
        if kept is not None and loss >= history[-1][1] * (1 - threshold):
            break
        if kept is not None:
            release(kept[2])
        kept = (experts, state, assigned)
        history.append((r, loss))
        if r < rounds:
            weighed = base.withColumn("w", _gate_weights(gate, state.weights)("x"))
            assigned = balanced_assign(weighed, m)
    experts, state, assigned = kept
    stage = GatedModel(inputCols=list(cols), experts=experts.tolist(), gate=state.weights.tolist(), hidden=hidden)
    told = spark.createDataFrame(history, "round int, loss double")
    return PipelineModel([stage]), told, assigned.select("id", "expert")
