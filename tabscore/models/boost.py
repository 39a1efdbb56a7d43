"""Second-order boosted trees from histograms.

Every row has a gradient g = p - y and a Hessian h = p (1 - p) of the logistic loss. A
pass over the rows adds up g, h and row counts for each node, feature and bin: a task
sends one row for each node and feature, whatever its rows. Splits, leaves and
the shrinking of every tree, the first too, follow from these sums:

    gain = GL^2/(HL + lambda) + GR^2/(HR + lambda) - G^2/(H + lambda)
    leaf = -eta * G / (H + lambda)

Trees grow level by level, or best first: the open leaf of the greatest gain is
split next, until there are ``splits`` of them.

Bins are those of the whole table's quantiles (``binning="global"``), where only the
smaller child of a split is counted and its sibling is the difference; or
each node lays equal bins over its own range of each feature (``binning="node"``), so
that deep nodes look closer: one pass for the ranges, one for the counts.

Missing values (NULL or NaN) go to the side that gains more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.models.gbt import first_fraction
from tabscore.operators.arrays import add_arrays, array_rows, hashed
from tabscore.operators.metrics import _binary
from tabscore.operators.reshape import to_long
from tabscore.sources.scratch import materialize, release

STORED_AFTER = 8  # trees that passes add to the stored margins before these are stored anew
TOO_LITTLE = 1e-9  # a gain that rounding may make

SUMS = 3  # gradient, Hessian, rows


@dataclass(frozen=True)
class BoostSettings:
    """``depth`` bounds the levels; ``splits`` (best first) the splits of a tree instead.

    ``criterion`` is ``newton`` or ``variance`` (the drop of the gradients' squared error,
    rows in place of Hessians). ``bag`` is the part of the rows each tree sees, drawn
    by their keys. ``start`` is the first margin, or ``"mean"`` for the log odds of the rows.
    """

    rounds: int = 50
    eta: float = 0.3
    depth: int = 6
    splits: int | None = None
    criterion: str = "newton"
    reg_lambda: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0
    min_rows: int = 1
    bins: int = 64
    binning: str = "global"
    bag: float = 1.0
    start: float | str = 0.0
    seed: int = 2016

    def __post_init__(self):
        if self.criterion not in ("newton", "variance"):
            raise ValueError(f"unknown criterion {self.criterion!r}")
        if self.binning not in ("global", "node"):
            raise ValueError(f"unknown binning {self.binning!r}")
        if not 2 <= self.bins <= 255:
            raise ValueError("bins are 2 to 255")


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. ``order`` numbers the splits."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[int] = field(default_factory=lambda: [1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    rows: list[float] = field(default_factory=lambda: [0.0])
    order: list[int] = field(default_factory=lambda: [-1])

    def split(self, node: int, cut: Cut) -> tuple[int, int]:
        """Make two leaves of one."""
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.threshold[node], self.missing_left[node] = cut.feature, cut.threshold, int(cut.missing_left)
        self.left[node], self.right[node], self.gain[node] = left, right, cut.gain
        self.order[node] = sum(o >= 0 for o in self.order)
        for _ in range(2):
            for name, empty in (("feature", -1), ("threshold", 0.0), ("missing_left", 1), ("left", -1), ("right", -1)):
                getattr(self, name).append(empty)
            for name, empty in (("value", 0.0), ("gain", 0.0), ("cover", 0.0), ("rows", 0.0), ("order", -1)):
                getattr(self, name).append(empty)
        return left, right

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix, in which NaN is missing."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, missing_left = np.array(self.left), np.array(self.right), np.array(self.missing_left, bool)
        at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(moving):
            moving = moving[feature[at[moving]] >= 0]
            node = at[moving]
            value = x[moving, feature[node]]
            goes_left = np.where(np.isnan(value), missing_left[node], value <= threshold[node])
            at[moving] = np.where(goes_left, left[node], right[node])
        return at


@dataclass(frozen=True)
class Cut:
    feature: int
    threshold: float
    missing_left: bool
    gain: float
    left: tuple[float, float, float]
    right: tuple[float, float, float]


@dataclass
class Leaf:
    """An open leaf: sums by feature and bin (bin 0 is missing), the upper edges of the bins, and its best cut."""

    node: int
    sums: np.ndarray
    edges: list[np.ndarray]
    depth: int
    cut: Cut | None = None

    @property
    def total(self) -> np.ndarray:
        return self.sums[0].sum(0)


def best_cut(settings: BoostSettings, sums: np.ndarray, edges: list[np.ndarray]) -> Cut | None:
    """The cut of greatest gain: of equal gains the first feature, the smallest threshold, missing values left."""
    best = None
    for f, upper in enumerate(edges):
        if not len(upper):
            continue
        total, missing = sums[f].sum(0), sums[f, 0]
        below = np.cumsum(sums[f, 1 : len(upper) + 1], 0)
        for missing_left in (True, False):
            left = below + missing if missing_left else below
            right = total - left
            if settings.criterion == "newton":
                gain = sum(s[:, 0] ** 2 / np.maximum(s[:, 1] + settings.reg_lambda, 1e-300) for s in (left, right))
                gain = gain - total[0] ** 2 / max(total[1] + settings.reg_lambda, 1e-300)
            else:
                gain = sum(s[:, 0] ** 2 / np.maximum(s[:, 2], 1e-300) for s in (left, right)) - total[0] ** 2 / max(total[2], 1e-300)
            fits = below[:, 2] > 0.5  # a known value on the left: missing values alone are the right side
            for side in (left, right):
                fits &= (side[:, 2] >= max(settings.min_rows, 1) - 0.5) & (side[:, 1] >= settings.min_hessian - 1e-9)
            gain = np.where(fits, gain, -np.inf)
            i = int(gain.argmax())
            if gain[i] > max(settings.min_gain, TOO_LITTLE * max(1.0, total[2])) and (best is None or gain[i] > best.gain * (1 + 1e-12)):
                best = Cut(f, float(upper[i]), missing_left, float(gain[i]), tuple(left[i]), tuple(right[i]))
            if not missing[2]:
                break
    return best


def _bag(keys: np.ndarray, settings: BoostSettings, tree: int) -> np.ndarray:
    """The rows of one tree's bag."""
    x = keys.view(np.uint64) ^ np.uint64((settings.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53 < settings.bag


@dataclass(frozen=True)
class Pass:
    """What the tasks of one pass need to know."""

    settings: BoostSettings
    width: int
    recent: list[Tree]
    tree: Tree
    number: int
    nodes: list[int]

    def read(self, batch: pa.RecordBatch):
        """Matrix, gradient, Hessian and place (in ``nodes``, else -1) of a batch's rows that are in the bag."""
        x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width)
        keys, y, m = (batch.column(c).to_numpy() for c in ("__k", "__y", "__m"))
        if self.settings.bag < 1:
            keep = _bag(keys, self.settings, self.number)
            x, y, m = x[keep], y[keep], m[keep]
        for t in self.recent:
            m = m + np.array(t.value)[t.leaf_of(x)]
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        place = np.full(len(self.tree.feature), -1)
        place[self.nodes] = np.arange(len(self.nodes))
        at = place[self.tree.leaf_of(x)]
        here = at >= 0
        return x[here], (p - y)[here], (p * (1 - p))[here], at[here]

    def empty(self, bins: int) -> np.ndarray:
        return np.zeros((len(self.nodes), self.width, bins + 1, SUMS))


def _add_bins(total: np.ndarray, bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add rows to the sums of their node, feature and bin."""
    nodes, width, depth, _ = total.shape
    for f in range(width):
        spot = at * depth + bins[:, f]
        for i, weights in enumerate((g, h, None)):
            total[:, f, :, i] += np.bincount(spot, weights, nodes * depth).reshape(nodes, depth)


def _sent(this: Pass, total: np.ndarray) -> pa.RecordBatch:
    node, feature = np.divmod(np.arange(len(this.nodes) * this.width), this.width)
    keys = {"node": np.array(this.nodes, np.int32)[node], "feature": feature.astype(np.int32)}
    return array_rows(keys, TaskContext.get().partitionId(), total.reshape(len(node), -1))


def _count_global(this: Pass, cuts: list[np.ndarray]):
    depth = max((len(c) for c in cuts), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = this.empty(depth)
        for batch in batches:
            x, g, h, at = this.read(batch)
            bins = np.empty(x.shape, np.int64)
            for f, c in enumerate(cuts):
                bins[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(c, x[:, f], "left"))
            _add_bins(total, bins, at, g, h)
        yield _sent(this, total)

    return run


def _ranges(this: Pass):
    """Least and greatest value of each node's features in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((len(this.nodes), this.width), np.inf)
        high = -low
        for batch in batches:
            x, _, _, at = this.read(batch)
            np.minimum.at(low, at, np.where(np.isnan(x), np.inf, x))
            np.maximum.at(high, at, np.where(np.isnan(x), -np.inf, x))
        node, feature = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(this.nodes, np.int32)[node]),
                pa.array(feature.astype(np.int32)),
                pa.array(low[node, feature]),
                pa.array(high[node, feature]),
            ],
            ["node", "feature", "low", "high"],
        )

    return run


def _count_ranges(this: Pass, low: np.ndarray, high: np.ndarray, bins: int):
    """Sums over equal bins of each node's own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = this.empty(bins)
        step = (high - low) / bins
        for batch in batches:
            x, g, h, at = this.read(batch)
            start, wide = low[at], step[at]
            known = ~np.isnan(x) & (wide > 0)
            wide = np.where(known, wide, 1.0)
            value = np.where(known, x, start)
            n = np.clip(np.ceil((value - start) / wide), 1, bins)
            # the edges, as they are told, decide
            n = np.where((n > 1) & (value <= start + (n - 1) * wide), n - 1, n)
            n = np.where((n < bins) & (value > start + n * wide), n + 1, n)
            _add_bins(total, np.where(np.isnan(x), 0, n).astype(np.int64), at, g, h)
        yield _sent(this, total)

    return run


class Booster:
    """Rows with their margins, and the trees so far."""

    def __init__(self, df: DataFrame, cols: list[str], settings: BoostSettings, label: str = "target", key: str = "id"):
        self.cols, self.settings, self.trees = list(cols), settings, []
        nan = F.lit(float("nan"))
        x = F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in cols])
        rows = df.select(hashed(key, settings.seed).alias("__k"), _binary(label).alias("__y"), x.alias("__x"))
        start = settings.start
        if start == "mean":
            mean = rows.agg(F.avg("__y")).first()[0]
            start = float(np.log(mean / (1 - mean))) if mean and mean < 1 else 0.0
        self.start = float(start)
        self.rows = materialize(rows.withColumn("__m", F.lit(self.start)), "boost")
        self.stored = 0  # trees that the stored margins hold
        self.cuts = self._quantiles(df) if settings.binning == "global" else None

    def _quantiles(self, df: DataFrame) -> list[np.ndarray]:
        """Bin edges of each feature: its values if they are no more than bins, else their quantiles."""
        bins = self.settings.bins
        probs = F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])
        known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.cols]
        found = df.agg(*[F.percentile_approx(x, probs, 10_000).alias(f"q{i}") for i, x in enumerate(known)]).first()
        cuts = [np.unique(np.array(q if q is not None else [], float)) for q in found]
        tied = [f for f, c in enumerate(cuts) if 0 < len(c) < bins]  # those may have few values
        if tied:
            long = to_long(df.select(*[known[f].alias(str(f)) for f in tied]), [], [str(f) for f in tied])
            values = long.filter("value is not null").distinct()
            few = [r["variable"] for r in values.groupBy("variable").count().filter(F.col("count") <= bins).collect()]
            each: dict[int, list[float]] = {int(f): [] for f in few}
            for r in values.filter(F.col("variable").isin(few)).collect() if few else []:  # features x bins at most
                each[int(r["variable"])].append(r["value"])
            for f, own in each.items():
                cuts[f] = np.array(sorted(own))
        return cuts

    def _pass(self, tree: Tree, nodes: list[int]) -> Pass:
        return Pass(self.settings, len(self.cols), self.trees[self.stored :], tree, len(self.trees), nodes)

    def _collect(self, run) -> dict[int, np.ndarray]:
        """Sums of each node: features, bins, three numbers."""
        sent = self.rows.mapInArrow(run, "node int, feature int, part int, values array<double>")
        table = add_arrays(sent, ["node", "feature"]).toArrow()
        out: dict[int, dict[int, np.ndarray]] = {}
        for node, f, values in zip(table["node"].to_pylist(), table["feature"].to_pylist(), table["values"]):
            out.setdefault(node, {})[f] = values.values.to_numpy().reshape(-1, SUMS)
        return {node: np.stack([fs[f] for f in range(len(self.cols))]) for node, fs in out.items()}

    def open_leaves(self, tree: Tree, parent: Leaf | None, nodes: list[tuple[int, int]]) -> list[Leaf]:
        """Leaves with their sums and best cuts. ``nodes`` are (node, depth); with one parent, its two children."""
        return self.open_many(tree, [(parent, nodes)])

    def open_many(self, tree: Tree, families: list[tuple[Leaf | None, list[tuple[int, int]]]]) -> list[Leaf]:
        """The leaves of several families in one pass (two with bins by node)."""
        if self.settings.binning == "node":
            leaves = self._by_range(tree, [n for _, nodes in families for n in nodes])
        else:
            leaves = self._by_quantile(tree, families)
        for leaf in leaves:
            g, h, n = leaf.total
            weight = h + (self.settings.reg_lambda if self.settings.criterion == "newton" else 0.0)
            tree.value[leaf.node] = -self.settings.eta * g / weight if weight > 1e-300 else 0.0
            tree.cover[leaf.node], tree.rows[leaf.node] = float(h), float(n)
            leaf.cut = best_cut(self.settings, leaf.sums, leaf.edges)
        return leaves

    def _by_quantile(self, tree: Tree, families) -> list[Leaf]:
        """Count the child with fewer rows; its sibling is what is left of the parent."""
        counted = []
        for parent, nodes in families:
            if parent is None:
                counted.append(nodes[0])
            else:
                counted.append(nodes[0] if parent.cut.left[2] <= parent.cut.right[2] else nodes[1])
        sums = self._collect(_count_global(self._pass(tree, [n for n, _ in counted]), self.cuts))
        bins = max((len(c) for c in self.cuts), default=0) + 2
        leaves = []
        for (parent, nodes), (one, depth) in zip(families, counted, strict=True):
            own = sums.get(one, np.zeros((len(self.cols), bins, SUMS)))
            for n, _ in nodes:
                leaves.append(Leaf(n, own if n == one else parent.sums - own, self.cuts, depth))
        return leaves

    def _by_range(self, tree: Tree, nodes: list[tuple[int, int]]) -> list[Leaf]:
        bins, width = self.settings.bins, len(self.cols)
        names = [n for n, _ in nodes]
        this = self._pass(tree, names)
        found = self.rows.mapInArrow(_ranges(this), "node int, feature int, low double, high double")
        found = found.groupBy("node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        low, high = np.zeros((len(nodes), width)), np.full((len(nodes), width), -1.0)
        place = {n: i for i, n in enumerate(names)}
        for r in found.collect():  # nodes x features
            low[place[r["node"]], r["feature"]], high[place[r["node"]], r["feature"]] = r["low"], r["high"]
        sums = self._collect(_count_ranges(this, low, high, bins))
        leaves = []
        for i, (n, depth) in enumerate(nodes):
            edges = []
            for a, b in zip(low[i], high[i], strict=True):
                inner = a + np.arange(1, bins) * ((b - a) / bins) if b > a else []
                edges.append(np.array([*inner, b] if b >= a else []))
            leaves.append(Leaf(n, sums.get(n, np.zeros((width, bins + 1, SUMS))), edges, depth))
        return leaves

    def grow(self) -> Tree:
        """One more tree."""
        tree, s = Tree(), self.settings
        leaves = self.open_leaves(tree, None, [(0, 0)])
        if s.splits is None:
            while leaves:
                families = []
                for leaf in leaves:
                    if leaf.cut and leaf.depth < s.depth:
                        a, b = tree.split(leaf.node, leaf.cut)
                        families.append((leaf, [(a, leaf.depth + 1), (b, leaf.depth + 1)]))
                leaves = self.open_many(tree, families) if families else []
        else:
            for _ in range(s.splits):
                cuttable = [leaf for leaf in leaves if leaf.cut]
                if not cuttable:
                    break
                best = max(cuttable, key=lambda leaf: (leaf.cut.gain, -leaf.node))
                a, b = tree.split(best.node, best.cut)
                leaves = [leaf for leaf in leaves if leaf is not best]
                leaves += self.open_leaves(tree, best, [(a, best.depth + 1), (b, best.depth + 1)])
        self.trees.append(tree)
        if len(self.trees) - self.stored >= STORED_AFTER:
            self._store()
        return tree

    def _store(self) -> None:
        """Write margins that hold all trees; passes then walk only newer ones."""
        recent, width = self.trees[self.stored :], len(self.cols)

        @F.pandas_udf("double")
        def moved(m: pd.Series, x: pd.Series) -> pd.Series:
            if not len(m):
                return m
            matrix = np.stack(x.to_numpy()).reshape(-1, width)
            return m + sum(np.array(t.value)[t.leaf_of(matrix)] for t in recent)

        before = self.rows
        self.rows = materialize(before.withColumn("__m", moved("__m", "__x")), "boost")
        self.rows.count()
        release(before)
        self.stored = len(self.trees)

    def close(self) -> None:
        release(self.rows)

    def model(self) -> PipelineModel:
        return PipelineModel([BoostModel.of(self.trees, self.cols, self.start)])


class BoostModel(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability of class 1 of boosted trees, from columns; NULL and NaN are missing."""

    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes of each tree", TypeConverters.toListInt)
    feature = Param(Params._dummy(), "feature", "feature of each node, -1 for leaves", TypeConverters.toListInt)
    left = Param(Params._dummy(), "left", "left child", TypeConverters.toListInt)
    right = Param(Params._dummy(), "right", "right child", TypeConverters.toListInt)
    missing_left = Param(Params._dummy(), "missing_left", "1 where missing values go left", TypeConverters.toListInt)
    order = Param(Params._dummy(), "order", "number of the split", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "largest value that goes left", TypeConverters.toListFloat)
    value = Param(Params._dummy(), "value", "margin of the node", TypeConverters.toListFloat)
    gain = Param(Params._dummy(), "gain", "gain of the split", TypeConverters.toListFloat)
    cover = Param(Params._dummy(), "cover", "sum of Hessians", TypeConverters.toListFloat)
    rows = Param(Params._dummy(), "rows", "rows of the node", TypeConverters.toListFloat)

    FIELDS = ("feature", "left", "right", "missing_left", "order", "threshold", "value", "gain", "cover", "rows")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="probability"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, trees: list[Tree], cols: list[str], start: float) -> BoostModel:
        out = cls(inputCols=list(cols), outputCol="probability")
        flat = {name: [v for t in trees for v in getattr(t, name)] for name in cls.FIELDS}
        return out._set(start=start, sizes=[len(t.feature) for t in trees], **flat)

    def trees(self) -> list[Tree]:
        flat = {name: self.getOrDefault(getattr(self, name)) for name in self.FIELDS}
        out, at = [], 0
        for n in self.getOrDefault(self.sizes):
            out.append(Tree(**{name: list(values[at : at + n]) for name, values in flat.items()}))
            at += n
        return out

    def margins(self, rounds: list[int]):
        """A column of margins after the given numbers of trees."""
        trees, start, width = self.trees(), self.getOrDefault(self.start), len(self.getInputCols())

        @F.pandas_udf("array<double>")
        def staged(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            matrix = np.stack(x.to_numpy()).reshape(-1, width)
            total, at = np.full((len(x), len(rounds)), start), np.array(rounds)
            for i, t in enumerate(trees, 1):
                if (at >= i).any():
                    total[:, at >= i] += np.array(t.value)[t.leaf_of(matrix)][:, None]
            return pd.Series(list(total))

        nan = F.lit(float("nan"))
        return staged(F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in self.getInputCols()]))

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = F.get(self.margins([len(self.getOrDefault(self.sizes))]), F.lit(0))
        out = df.withColumn("__m", margin)
        p1 = 1 / (1 + F.exp(-F.col("__m")))
        label = F.when(F.col("__m") > 0, 1.0).otherwise(0.0)
        return out.withColumns({self.getOutputCol(): array_to_vector(F.array(1 - p1, p1)), "prediction": label}).drop("__m")


def boost(
    df: DataFrame,
    cols: list[str],
    label: str = "target",
    key: str = "id",
    train_fraction: float | None = None,
    **settings,
) -> PipelineModel:
    """Boosted trees; see ``BoostSettings`` and the module. Keys are unique.

    ``train_fraction`` fits on the first part of the rows in ``key`` order.
    """
    if train_fraction is not None:
        df, _ = first_fraction(df, key, train_fraction)
    booster = Booster(df, cols, BoostSettings(**settings), label, key)
    try:
        for _ in range(booster.settings.rounds):
            booster.grow()
        return booster.model()
    finally:
        booster.close()


def boost_stages(model: PipelineModel, df: DataFrame, keep: Iterable[str], rounds: Iterable[int] | None = None) -> DataFrame:
    """``*keep, round, score``: the margin after each round, or the given ones."""
    stage = model.stages[-1]
    wanted = list(rounds) if rounds is not None else list(range(1, len(stage.getOrDefault(stage.sizes)) + 1))
    each = df.select(*keep, F.posexplode(stage.margins(wanted)).alias("__at", "score"))
    return each.select(*keep, F.get(F.array(*[F.lit(r) for r in wanted]), F.col("__at")).alias("round"), "score")


def boost_importance(model: PipelineModel) -> DataFrame:
    """``feature, gain, splits, share``: the gains of a feature's splits, their number and part of all gains."""
    stage = model.stages[-1]
    names = stage.getInputCols()
    gains, splits = np.zeros(len(names)), np.zeros(len(names), int)
    for t in stage.trees():
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                gains[f] += g
                splits[f] += 1
    total = gains.sum() or 1.0
    rows = [(n, float(g), int(s), float(g / total)) for n, g, s in zip(names, gains, splits)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, gain double, splits long, share double")
    return frame.orderBy(F.desc("share"), "feature")


def boost_trees(model: PipelineModel) -> DataFrame:
    """One row for each node: ``tree, node, split_order, feature, threshold, missing_left, gain, cover, n_rows, value``."""
    stage = model.stages[-1]
    names = stage.getInputCols()
    rows = []
    for i, t in enumerate(stage.trees(), 1):
        for n, f in enumerate(t.feature):
            split = (t.order[n] + 1, names[f], t.threshold[n], bool(t.missing_left[n]), t.gain[n]) if f >= 0 else (None,) * 5
            rows.append((i, n, *split, t.cover[n], round(t.rows[n]), t.value[n], t.left[n] if f >= 0 else None, t.right[n] if f >= 0 else None))
    schema = (
        "tree int, node int, split_order int, feature string, threshold double, missing_left boolean, gain double, "
        "cover double, n_rows long, value double, left_node int, right_node int"
    )
    return SparkSession.active().createDataFrame(rows, schema)
