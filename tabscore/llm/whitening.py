"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. One pass over the rows multiplies it by a block of
vectors Q: tasks add up Xc' (Xc Q) of their centred rows, and what leaves a task
is as large as Q. Each round puts the block through a Chebyshev polynomial of the
covariance (one pass for each degree), which damps the unwanted part of the
spectrum and lets the rest grow, then QR and Rayleigh-Ritz give eigenvalues and
eigenvectors of the block. Vectors whose residual is that of rounding are locked;
the rounds end when all wanted ones are, and a last Rayleigh-Ritz over all of them
certifies the result.

The unwanted interval ends at the smallest Ritz value of the block and begins at a
lower bound of the spectrum from a few Lanczos steps. The degree is the largest that
keeps the growth within ``GROWTH``, so that the strongest direction does not drown
the others before it is locked. Where a round gains too little, as with more equal
eigenvalues than the block has vectors, the block is widened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.tables import Scratch
from tabscore.llm.words import lists

COMPONENTS = 32
GUARD = 16  # vectors of the block beyond the wanted ones
UNIT, SHIFT = 64.0, 1_000_000  # an entry c becomes floor(UNIT * c) + SHIFT
LARGEST = 2.0**40  # entries beyond it (after UNIT) have no exact sums
LANCZOS = 6
DEGREE = 12
GROWTH = 1e10
LOCKED = 2e-14  # residual of a locked vector, as a part of the largest eigenvalue
CERTIFIED = 1e-12
ZERO = 1e-11  # eigenvalues below this part of the largest are those of no direction
ROUNDS = 200
SLOW = 0.1  # a round that leaves more than this part of the residual widens the block


@dataclass
class Fit:
    """Exact sums of one dimension's rows, and the components found."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None  # one column for each component
    passes: int = 0

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector is whole, its entries as long."""
    for batch in batches:
        e = batch.column("e")
        values = e.flatten()
        flat = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(float), nan=np.nan, posinf=np.nan, neginf=np.nan)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(e), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        broken = np.zeros(len(sizes), bool)
        broken[row[np.isnan(flat)]] = True
        keep = ~broken & (sizes > 0)
        x = np.floor(UNIT * flat[keep[row]])
        if (np.abs(x) >= LARGEST).any():
            raise ValueError("an embedding has an entry beyond 2**34 in size")
        edges = np.concatenate([[0], np.cumsum(sizes[keep])])
        ids = batch.column("vec_id").filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([ids, lists(x.astype(np.int64) + SHIFT, edges)], ["vec_id", "x"])


def _sums(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension), pa.array(sums, pa.int64())], ["j", "n", "s"]
            )

    return run


def _centre(fit: Fit):
    """Integers to doubles around the exact mean: the whole part goes before the conversion."""
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    part = np.array([s % fit.n / fit.n for s in fit.sums])
    return lambda x: (x - whole).astype(float) - part


def _products(fit: Fit, q: np.ndarray):
    """Of each task's rows, Xc' (Xc Q), and the sums of squares as the last column."""
    dimension, width = q.shape
    centre = _centre(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, width + 1))
        for batch in batches:
            x = centre(_matrix(batch.column("x"), dimension))
            total[:, :width] += x.T @ (x @ q)
            total[:, width] += (x * x).sum(0)
        edges = np.arange(dimension + 1) * (width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), lists(total.ravel(), edges)], ["j", "sums"])

    return run


def _collected(rows: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of the tasks' matrices: ``height`` rows of ``width`` numbers come to the driver."""
    added = rows.groupBy("j").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    out = np.zeros((height, width))
    for r in added.collect():
        out[r["j"]] = r["sums"]
    return out


class Covariance:
    """The covariance of the rows as an operator on blocks of vectors: one pass for each product."""

    def __init__(self, rows: DataFrame, fit: Fit):
        self.rows, self.fit = rows, fit

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        d, width = q.shape
        out = _collected(self.rows.mapInArrow(_products(self.fit, q), "j int, sums array<double>"), d, width + 1)
        self.fit.passes += 1
        self.fit.trace = math.fsum(out[:, width]) / self.fit.n
        return out[:, :width] / self.fit.n


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of an orthonormal block."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, np.linalg.norm(vq - q * values, axis=0)


def least_eigenvalue(v, d: int, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """A lower bound of the spectrum: the smallest Ritz value of some Lanczos steps, less its residual."""
    q = rng.normal(size=(d, 1))
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, d)):
        w = v @ basis[-1]
        diagonal.append(float((basis[-1].T @ w)[0, 0]))
        known = np.hstack(basis)
        for _ in range(2):
            w = w - known @ (known.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-13 * max(abs(diagonal[0]), 1e-300):
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def chebyshev(v, q: np.ndarray, low: float, high: float, top: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """The block under the Chebyshev polynomial of [low, high], scaled to 1 at ``top``, off the locked vectors."""

    def free(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    centre, half = (high + low) / 2, (high - low) / 2
    first = scale = half / (top - centre)
    before, now = q, free(v @ q - centre * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, free((v @ now - centre * now) * (2 * after / half) - before * (scale * after))
        scale = after
    return now


def leading_components(v, d: int, wanted: int, guard: int = GUARD, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of a positive operator ``v`` on blocks."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    width = min(d, wanted + guard)
    locked = np.zeros((d, 0))
    values, q, residual = ritz(block := np.linalg.qr(rng.normal(size=(d, width)))[0], v @ block)
    top = values[0]
    if top <= 0:
        return values[:wanted], q[:, :wanted]
    low, rounds, best = None, 0, np.inf
    while True:
        # lock from the largest on, so that what is still open is below it
        done = 0
        while done < len(values) and locked.shape[1] + done < wanted and residual[done] <= LOCKED * math.sqrt(d) * top:
            done += 1
        if done:
            locked = np.linalg.qr(np.hstack([locked, q[:, :done]]))[0]
            q, values, residual = q[:, done:], values[done:], residual[done:]
        if locked.shape[1] == wanted or rounds == ROUNDS:
            break
        worst = float(residual[: wanted - locked.shape[1]].max())
        if worst > SLOW * best:
            if worst <= CERTIFIED * top:  # held up by rounding: the certificate decides
                break
            # more eigenvalues lie close to the wanted ones than the block has room for
            more = min(q.shape[1], d - q.shape[1] - locked.shape[1])
            if more:
                known = np.hstack([locked, q])
                q = np.linalg.qr(np.hstack([known, rng.normal(size=(d, more))]))[0][:, locked.shape[1] :]
                values, q, residual = ritz(q, v @ q)
                best = np.inf
                continue
        best = min(best, worst)
        low = least_eigenvalue(v, d, rng) if low is None else min(low, max(0.0, values[-1]))
        high = max(values[-1], low + 1e-9 * top)
        centre, half = (high + low) / 2, (high - low) / 2
        reach = max(values[0], high * (1 + 1e-6))
        degree = max(1, min(DEGREE, int(math.acosh(GROWTH) / math.acosh((reach - centre) / half))))
        y = chebyshev(v, q, low, high, reach, degree, locked)
        q = np.linalg.qr(y / np.maximum(np.linalg.norm(y, axis=0), 1e-300))[0]
        q = np.linalg.qr(q - locked @ (locked.T @ q))[0]
        values, q, residual = ritz(q, v @ q)
        rounds += 1
    every = np.linalg.qr(np.hstack([locked, q]))[0]
    values, every, residual = ritz(every, v @ every)
    if residual[:wanted].max() > CERTIFIED * top:
        raise ArithmeticError(f"components are not certified: residual {residual[:wanted].max() / top:.1e} of the largest eigenvalue")
    return values[:wanted], every[:, :wanted]


def _scores(fit: Fit):
    """``vec_id, deviation, whitened`` of each row."""
    dimension = fit.dimension
    centre = _centre(fit)
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([s % fit.n for s in fit.sums], np.int64)
    to_white = fit.vectors / np.sqrt(fit.values)

    def deviations(x: np.ndarray) -> pa.Array:
        off = x - whole
        largest = fit.n * (int(np.abs(off).max(initial=0)) + 1)
        if largest * largest * dimension < 2**63:
            return pa.array(((off * fit.n - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        sums = [sum((a * fit.n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]
        return pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            white = centre(x) @ to_white
            edges = np.arange(len(x) + 1) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), deviations(x), lists(white.ravel(), edges)], ["vec_id", "deviation", "whitened"]
            )

    return run


def _white_products(fit: Fit):
    """Of each task's rows, W' W and the sums of W as the last row."""
    dimension, width = fit.vectors.shape
    centre = _centre(fit)
    to_white = fit.vectors / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            w = centre(_matrix(batch.column("x"), dimension)) @ to_white
            total[:width] += w.T @ w
            total[width] += w.sum(0)
        edges = np.arange(width + 2) * width
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), lists(total.ravel(), edges)], ["j", "sums"])

    return run


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    width = len(fit.values)
    total = _collected(rows.mapInArrow(_white_products(fit), "j int, sums array<double>"), width + 1, width)
    mean = total[width] / fit.n
    return float(np.abs(total[:width] / fit.n - np.outer(mean, mean) - np.eye(width)).max())


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, guard: int = GUARD
) -> DataFrame:
    """``vec_id, dimension, n, deviation, whitened, values, trace, identity_error`` of each row with a whole vector.

    An entry c is the integer floor(64 c) + 1000000. ``whitened`` holds the centred
    row projected on each component over the root of its eigenvalue, ``values`` the
    eigenvalues (falling), ``trace`` that of the covariance; ``deviation`` is
    the exact sum of (n x - S)^2 over the dimensions, ``identity_error`` one number of the fit.

    Rows whose vector is null, empty, or holds null or non-finite entries go. Vectors
    of different dimension are fitted apart. Directions without variance have no
    component, so rows that are all equal (or one row) give empty arrays and an error of 0. Repeated
    rows and ids count as often as they occur; an id may be null. An entry
    beyond 2**34 in size raises. An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    named = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    whole = scratch.save(named.mapInArrow(_integers, "vec_id long, x array<long>"), "integers")
    out = None
    for (d,) in whole.select(F.size("x").alias("d")).distinct().orderBy("d").collect():  # one for each dimension that occurs
        part = whole.filter(F.size("x") == d)
        sums = part.select("x").mapInArrow(_sums(d), "j int, n long, s long").groupBy("j").agg(F.sum("n"), F.sum("s")).collect()
        fit = Fit(sums[0][1], [s for _, _, s in sorted(sums)])
        v = Covariance(part.select("x"), fit)
        values, vectors = leading_components(v, d, components, guard)
        real = values > ZERO * max(values[0], 0.0)
        fit.values, fit.vectors = values[real], vectors[:, real]
        error = identity_error(part.select("x"), fit) if real.any() else 0.0
        scored = part.mapInArrow(_scores(fit), "vec_id long, deviation decimal(38,0), whitened array<double>").select(
            "vec_id",
            F.lit(d).alias("dimension"),
            F.lit(fit.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.lit(fit.values.tolist()).cast("array<double>").alias("values"),
            F.lit(fit.trace).alias("trace"),
            F.lit(error).alias("identity_error"),
        )
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        schema = "vec_id long, dimension int, n long, deviation decimal(38,0), whitened array<double>, values array<double>, trace double, identity_error double"
        return spark.createDataFrame([], schema)
    return out


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1: its whitened value and the share of variance explained."""
    each = whitened.select("*", F.posexplode(F.arrays_zip("whitened", "values")).alias("at", "one"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        F.col("one.whitened").alias("whitened"),
        (F.col("one.values") / F.col("trace")).alias("explained"),
        "identity_error",
    )
