"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector of each group.

A vector belongs to the cell of its nearest centre, and visits cells with a
smaller number that a linked vector may belong to. If x is in cell A and y in
cell B, then <x, A - B> <= <x - y, A - B> <= |x - y| |A - B|, and linked unit
vectors are at most the chord sqrt(2 - 2 * threshold) apart. With ``margin`` 1 no
link is lost, whatever the centres are. The default takes four deviations of a chord
in a random direction of the space that the vectors spread over: 4 / sqrt(directions) of its
length, where the directions are counted by the eigenvalues of the sample's covariance
((sum)^2 / sum of squares). Vectors of up to sixteen directions get the full margin.

Cells are a tree. A cell with too many vectors is dealt again by centres of its own,
fitted on a bounded sample of it, until cells are small at any number of vectors or a split
no longer saves half of the products (a crowd of vectors that are all near each other).
A visitor y of a split cell visits each part B that a linked vector may belong to: by the same
inequality <y, A - B> is at most |x - y| |A - B| for y's nearest part A. What stays
large is compared by pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.near_text import find, runs, union
from tabscore.llm.tables import Scratch, components

THRESHOLD = 0.95
TRAIN_ROWS = 5_000  # the bound of the sample that centres are fitted on
CELL = 500  # vectors of a cell, about
FAN = 256  # cells that a cell, or the whole table, is split into at once
SPLIT = 2_000  # cells with more vectors are split again
DEVIATIONS = 4  # of a chord along a difference of centres, within the default margin
LEVELS = 7  # FAN**LEVELS cells have numbers of their own; cells that are larger still stay whole
DEAL = 20_000  # vectors of a cell that one task deals to its parts
BLOCK = 1_000  # vectors of a block; a cell's blocks are compared in pairs


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vector of each row in double precision, and a key of its bytes; null where there is none."""
    for batch in batches:
        units, keys = [], []
        for row in batch.column("e").to_pylist():
            x = np.array([np.nan if e is None else e for e in row or []], np.float64)
            top = np.abs(x).max(initial=0)
            if not np.isfinite(x).all() or top == 0:
                units.append(None)
                keys.append(None)
                continue
            x = x / top
            x = x / np.sqrt(x @ x) + 0.0
            units.append(x)
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
            ["vec_id", "copy", "v"],
        )


def fit_centres(vectors: DataFrame, n: int, dim: int, seed: int = 11) -> tuple[np.ndarray, float]:
    """Unit centres by spherical k-means over a sample of about ``TRAIN_ROWS`` vectors, and the directions these spread over."""
    sample = vectors.filter(_share(F.lit(max(1, n)), 0)).select(array_to_vector("v").alias("features"))
    points = sample.coalesce(6).persist()
    drawn = np.array([r["features"].toArray() for r in points.collect()]).reshape(-1, dim)
    k = min(FAN, len(drawn), max(1, round(n / CELL)))
    if k < 2:
        points.unpersist()
        return np.eye(1, dim), 1.0
    means = KMeans(k=k, maxIter=8, seed=seed, distanceMeasure="cosine", initMode="random").fit(points)
    centres = np.array(means.clusterCenters())
    points.unpersist()
    return _unit_rows(centres), directions(drawn)


def _share(n: Column, level: int) -> Column:
    """Whether a vector is in the sample of about ``TRAIN_ROWS`` of ``n``."""
    draw = F.pmod(F.xxhash64("copy", F.lit(level)), F.lit(1_000_003)) if level else F.pmod(F.xxhash64("copy"), F.lit(1_000_003))
    return draw < F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / n) * 1_000_003


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def directions(points: np.ndarray) -> float:
    """How many directions points spread over: the squared sum of their covariance's eigenvalues over the sum of squares."""
    spread = np.cov(points.T, bias=True).reshape(points.shape[1], -1)
    squares = float((spread * spread).sum())
    return max(1.0, float(np.trace(spread)) ** 2 / squares) if squares > 0 else 1.0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _visits(v: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each vector, and all cells that a vector linked to it may belong to."""
    near = v @ centres.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(v)), home][:, None] - near
    return home, gap <= reach * apart[home]


def _apart(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 * (centres**2).sum(axis=1).max() - 2 * centres @ centres.T)) + 1e-7


def _assign(centres: np.ndarray, reach: float):
    """Each vector with its home cell, and with the cells of smaller number that it visits."""
    apart, cells = _apart(centres), np.arange(len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                home, meets = _visits(_matrix(part.column("v"), centres.shape[1]), centres, apart, reach)
                row, cell = np.nonzero(meets & (cells[None, :] < home[:, None]))
                yield _dealt(part, home, row, cell, np.ones(len(part), bool), 0)

    return run


def _dealt(part: pa.RecordBatch, home: np.ndarray, row: np.ndarray, cell: np.ndarray, at_home: np.ndarray, parent: int) -> pa.RecordBatch:
    """Rows at home in their cell, then the visits; parts of a cell are numbered after it as in a tree of arrays."""
    own = np.flatnonzero(at_home)
    rows = pa.array(np.concatenate([own, row]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), parent, np.int64)),
            pa.array(parent * FAN + 1 + np.concatenate([home[own], cell]).astype(np.int64)),
            pa.array(np.arange(len(rows)) < len(own)),
            *[part.column(c).take(rows) for c in ("copy", "n", "v")],
        ],
        ["parent", "cell", "home", "copy", "n", "v"],
    )


def _spherical(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a small sample by Lloyd's steps; a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (points @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, points)
        length = np.linalg.norm(total, axis=1)
        some = length > 0
        centres[some] = total[some] / length[some][:, None]
    return centres


def _fit_parts(dim: int, threshold: float, margin: float | None):
    """Centres of the parts of each cell, from the cell's sample, and how far a visit reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            cell, homes = table.column("cell").to_numpy(), table.column("homes").to_numpy()
            v = _matrix(table.column("v").combine_chunks(), dim)
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = min(FAN, b - a, max(2, round(int(homes[a]) / CELL)))
                centres = _spherical(v[a:b], k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(cell[a])]),
                        pa.array([reach_of(directions(v[a:b]), threshold, margin)]),
                        pa.array([centres.reshape(-1)], pa.list_(pa.float64())),
                    ],
                    ["cell", "reach", "centres"],
                )

    return run


def reach_of(spread: float, threshold: float, margin: float | None) -> float:
    """How far a vector may lie beyond the border to a cell and still visit it, for centres one apart."""
    margin = min(1.0, DEVIATIONS / math.sqrt(spread)) if margin is None else margin
    return margin * math.sqrt(2 - 2 * threshold) + 1e-9


def _deal_parts(dim: int):
    """Rows of split cells with their parts; each task has a cell's centres in a row before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = apart = None
        reach = 0.0
        for batch in batches:
            key = np.stack([batch.column("cell").to_numpy(), batch.column("salt").to_numpy()], axis=1)
            begins = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(batch)]])
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if a == b:
                    continue
                if batch.column("reach")[int(a)].as_py() is not None:
                    reach = batch.column("reach")[int(a)].as_py()
                    centres = np.array(batch.column("v")[int(a)].as_py()).reshape(-1, dim)
                    apart = _apart(centres)
                    a += 1
                cells = np.arange(len(centres))
                for k in range(a, b, 2000):
                    part = batch.slice(k, min(2000, b - k))
                    home, meets = _visits(_matrix(part.column("v"), dim), centres, apart, reach)
                    at_home = part.column("home").to_numpy(zero_copy_only=False)
                    meets &= (cells[None, :] < home[:, None]) | ~at_home[:, None]
                    yield _dealt(part, home, *np.nonzero(meets), at_home, int(key[a][0]))

    return run


def _block_links(threshold: float, dim: int):
    """Cosines of block pairs: each vector's number of links there, and its root in the forest of links.

    ``side`` is -1 for the vectors of the first block, 1 for those of the second, 0 for a
    block with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "pair"):
            pair, side, n = (table.column(c).to_numpy() for c in ("pair", "side", "n"))
            copy = table.column("copy").combine_chunks()
            copy = copy.chunk(0) if isinstance(copy, pa.ChunkedArray) else copy
            vectors = table.column("v").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            v = _matrix(vectors, dim)
            edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                left, right = np.flatnonzero(side[a:b] <= 0), np.flatnonzero(side[a:b] >= 0)
                itself = not side[a:b].any()
                if not len(left) or not len(right):
                    continue
                degree, root = np.zeros(b - a, np.int64), np.arange(b - a)
                for k in range(0, len(left), 500):
                    some = left[k : k + 500]
                    linked = v[a + some] @ v[a + right].T >= threshold
                    if itself:
                        linked &= some[:, None] != right[None, :]
                    degree[some] += linked @ n[a + right]
                    if not itself:
                        degree[right] += n[a + some] @ linked
                    i, j = np.nonzero(linked)
                    union(root, some[i], right[j])
                top = find(root)
                hit = np.flatnonzero(degree > 0)
                yield pa.RecordBatch.from_arrays(
                    [copy.take(pa.array(a + hit)), copy.take(pa.array(a + top[hit])), pa.array(degree[hit])],
                    ["a", "b", "links"],
                )

    return run


def _sizes(dealt: DataFrame) -> DataFrame:
    """``parent, cell, homes, guests, work`` of each cell; work is the number of cosines."""
    homes, guests = F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")
    return dealt.groupBy("parent", "cell").agg(homes, guests).withColumn("work", F.expr("homes * (homes / 2.0 + guests)"))


def _split(scratch: Scratch, dealt: DataFrame, level: int, dim: int, threshold: float, margin: float | None) -> DataFrame:
    """The parts of cells, each dealt by centres of its own sample. ``dealt`` has the sizes of the cells."""
    sample = dealt.filter(F.col("home") & _share(F.col("homes"), level)).select("cell", "homes", "copy", "v")
    sample = sample.repartition("cell").sortWithinPartitions("cell", "copy")
    fitted = sample.mapInArrow(_fit_parts(dim, threshold, margin), "cell long, reach double, centres array<double>")
    fitted = scratch.save(fitted, f"centres-{dim}-{level}")
    salts = F.ceil((F.col("homes") + F.col("guests")) / DEAL).cast("int")
    rows = dealt.withColumn("salt", F.pmod(F.xxhash64("copy", F.lit(9)), salts).cast("int")).select(
        "cell", "salt", F.lit(None).cast("double").alias("reach"), "home", "copy", "n", "v"
    )
    counts = dealt.groupBy("cell").agg(F.first(salts).alias("salts"))
    first = fitted.join(counts, "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        "reach",
        F.lit(True).alias("home"),
        F.lit(None).cast("binary").alias("copy"),
        F.lit(0).cast("long").alias("n"),
        F.col("centres").alias("v"),
    )
    met = rows.union(first).repartition("cell", "salt")
    met = met.sortWithinPartitions("cell", "salt", F.col("reach").asc_nulls_last())
    return scratch.save(met.mapInArrow(_deal_parts(dim), DEALT), f"cells-{dim}-{level}")


DEALT = "parent long, cell long, home boolean, copy binary, n long, v array<double>"


def _cells(scratch: Scratch, own: DataFrame, n: int, dim: int, threshold: float, margin: float | None) -> DataFrame:
    """``cell, home, copy, n, v, homes, guests``: all vectors in the cells that they belong to or visit, with the cells' sizes."""
    centres, spread = fit_centres(own, n, dim)
    dealt = scratch.save(own.mapInArrow(_assign(centres, reach_of(spread, threshold, margin)), DEALT), f"cells-{dim}-0")
    sizes = scratch.save(_sizes(dealt), f"sizes-{dim}-0")
    done = []
    for level in range(1, LEVELS):
        large = sizes.filter(F.col("homes") > SPLIT)
        if large.isEmpty():
            break
        parts = _split(scratch, dealt.drop("parent").join(large.drop("parent"), "cell"), level, dim, threshold, margin)
        part_sizes = scratch.save(_sizes(parts), f"sizes-{dim}-{level}")
        work = part_sizes.groupBy(F.col("parent").alias("cell")).agg(F.sum("work").alias("after"))
        worth = large.join(work, "cell").filter("after <= work / 2").select("cell")
        worth = scratch.save(worth, f"split-{dim}-{level}")
        done.append((dealt, sizes.join(worth, "cell", "left_anti")))
        parents = worth.withColumnRenamed("cell", "parent")
        dealt = parts.join(parents, "parent", "left_semi").select(*parts.columns)
        sizes = part_sizes.join(parents, "parent", "left_semi").select(*part_sizes.columns)
    done.append((dealt, sizes))
    columns = ["cell", "home", "copy", "n", "v", "homes", "guests"]
    found = [rows.drop("parent").join(kept.drop("parent"), "cell").select(*columns) for rows, kept in done]
    return reduce(DataFrame.union, found).filter("homes > 0")


def _links(scratch: Scratch, own: DataFrame, n: int, dim: int, threshold: float, margin: float | None) -> DataFrame:
    """``a, b, links``: parts of each vector's number of links, each with a vector it is linked to by a chain."""
    rows = _cells(scratch, own, n, dim, threshold, margin)
    for count in ("homes", "guests"):
        rows = rows.withColumn(count, F.ceil(F.col(count) / BLOCK).cast("int"))
    at = F.pmod(F.xxhash64("copy", F.lit(5)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    rows = rows.withColumn("at", at)

    def up_to(count: str):
        return F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), 1, F.col(count))

    def pair(kind: int, i, j, side):
        return F.struct(F.xxhash64("cell", F.lit(kind), i, j).alias("pair"), side.cast("int").alias("side"))

    own_at = F.col("at")
    with_homes = F.transform(
        up_to("homes"), lambda j: pair(0, F.least(own_at, j), F.greatest(own_at, j), F.signum(own_at - j))
    )
    with_guests = F.transform(up_to("guests"), lambda g: pair(1, own_at, g, F.lit(-1)))
    as_guest = F.transform(up_to("homes"), lambda i: pair(1, i, own_at, F.lit(1)))
    pairs = F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)
    met = rows.select("copy", "n", "v", F.inline(pairs)).repartition("pair").sortWithinPartitions("pair")
    return met.mapInArrow(_block_links(threshold, dim), "a binary, b binary, links long")


def near_duplicates(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    margin: float | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links are cosines >= threshold.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Copies (equal unit vectors, repeated rows too) are one node
    with their number; they link with each other. component_id is the smallest vec_id
    reachable by links, itself included. Vectors of different dimension don't link. An
    empty table gives no rows; other columns are not read.

    ``margin`` 1 finds every link. The default may lose links across cells where linked
    vectors differ in other directions than the vectors at large; see the module.
    """
    scratch = Scratch(rows.sparkSession, "near-vector")
    named = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    units = scratch.save(named.mapInArrow(_units, "vec_id long, copy binary, v array<double>"), "units")
    distinct = units.filter("copy is not null").groupBy("copy").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = scratch.save(distinct, "distinct")
    sizes = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    found = scratch.spark.createDataFrame([], "a binary, b binary, links long")
    for d in sizes:  # one for each dimension that occurs
        part = distinct.filter(F.size("v") == d["d"])
        found = found.union(_links(scratch, part, d["n"], d["d"], threshold, margin))
    found = scratch.save(found, "found")
    degree = found.groupBy(F.col("a").alias("copy")).agg(F.sum("links").alias("links"))
    roots = components(scratch, found).withColumnRenamed("node", "copy")
    nodes = distinct.select("copy", "n").join(degree, "copy", "left").join(roots, "copy", "left")
    nodes = nodes.select("copy", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "copy").alias("root"))
    full = scratch.save(units.drop("v").join(nodes, "copy", "left"), "full")
    least = full.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return full.join(least, "root", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
