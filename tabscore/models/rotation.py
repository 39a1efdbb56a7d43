"""Rotation forest: decision trees on randomly rotated features."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.models.grid import fit_all
from tabscore.models.pruning import prune_tree
from tabscore.models.stages import ClassVector, MeanProbability


def member_covariances(
    df: DataFrame, cols: list[str], members: int, key: str, seed: int, share: float
) -> list[np.ndarray]:
    """Feature covariance on each member's row sample, in one pass for all members.

    Tasks add up cross products of their rows; what leaves a task is one row
    per (member, feature), whatever the number of rows.
    """
    k = len(cols)
    names = [f"__s{m}" for m in range(members)]
    sampled = df.select(
        *[F.col(c).cast("double").alias(c) for c in cols],
        *[(F.pmod(F.xxhash64(F.col(key), F.lit(seed + m)), F.lit(10_000)) < int(share * 10_000)).alias(n)
          for m, n in enumerate(names)],
    )

    def cross_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((members, k + 1, k + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[cols].to_numpy(dtype=float)])
            for m, n in enumerate(names):
                inside = x[batch[n].to_numpy(dtype=bool)]
                total[m] += inside.T @ inside
        member, row = np.divmod(np.arange(members * (k + 1)), k + 1)
        yield pd.DataFrame({"member": member, "row": row, "sums": list(total.reshape(-1, k + 1))})

    sums = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(k + 1)]
    rows = (
        sampled.mapInPandas(cross_products, "member int, row int, sums array<double>")
        .groupBy("member", "row")
        .agg(*sums)
        .collect()  # members * (features + 1) rows
    )
    grams = np.zeros((members, k + 1, k + 1))
    for r in rows:
        grams[r["member"], r["row"]] = [r[f"s{j}"] for j in range(k + 1)]
    out = []
    for g in grams:
        n = max(g[0, 0], 2.0)
        mean = g[0, 1:] / n
        out.append((g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1))
    return out


def rotation_forest(
    df: DataFrame,
    cols: list[str],
    members: int = 10,
    subsets: int | None = None,
    seed: int = 2016,
    label: str = "target",
    key: str = "id",
    depth: int = 5,
    share: float = 0.75,
    parallelism: int = 2,
    prune: float | None = None,
) -> PipelineModel:
    """Mean of ``members`` trees, each on its own rotation of the features.

    ``prune`` cuts each tree to the one that is best when a leaf costs that part of
    the root's risk (grow them deep then); without it trees stay as they are grown.

    Per member the features are dealt into ``subsets`` random groups (default:
    three features a group); each group is rotated to its principal axes on a
    ``share`` row sample. All axes are kept and the tree sees all rows.
    """
    subsets = subsets or max(1, round(len(cols) / 3))
    covariances = member_covariances(df, cols, members, key, seed, share)
    rotations = []
    for m in range(members):
        order = list(range(len(cols)))
        random.Random(seed + m).shuffle(order)
        axes = []
        for g in range(subsets):
            group = sorted(order[g::subsets])
            _, vectors = np.linalg.eigh(covariances[m][np.ix_(group, group)])
            for axis in vectors.T[::-1]:
                terms = [f"`{cols[i]}` * {float(w)!r}D" for i, w in zip(group, axis)]
                axes.append(" + ".join(terms))
        rotations.append(axes)

    def member(data: DataFrame, m: int) -> PipelineModel:
        names = [f"__r{m}_{i}" for i in range(len(rotations[m]))]
        rotated = ", ".join(f"{e} AS {n}" for e, n in zip(rotations[m], names))
        rotate = SQLTransformer(statement=f"SELECT *, {rotated} FROM __THIS__")
        vector = VectorAssembler(inputCols=names, outputCol=f"__v{m}")
        tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}) FROM __THIS__")
        tree = DecisionTreeClassifier(
            labelCol=label,
            featuresCol=f"__v{m}",
            maxDepth=depth,
            seed=seed + m,
            predictionCol=f"__c{m}",
            rawPredictionCol=f"__w{m}",
            probabilityCol=f"__p{m}",
        )
        fitted = tree.fit(vector.transform(rotate.transform(data.select(label, *cols))).select(label, f"__v{m}"))
        if prune is not None:
            cut = prune_tree(fitted, names, prune, f"__q{m}")
            gone = SQLTransformer(statement=f"SELECT * EXCEPT (__q{m}, {', '.join(names)}) FROM __THIS__")
            return PipelineModel([rotate, cut, ClassVector(inputCol=f"__q{m}", outputCol=f"__p{m}"), gone])
        drop = SQLTransformer(statement=f"SELECT * EXCEPT (__v{m}, __c{m}, __w{m}) FROM __THIS__")
        return PipelineModel([rotate, vector, tidy, fitted, drop])

    fitted = fit_all(member, [{"m": m} for m in range(members)], df, parallelism)
    mean = MeanProbability(inputCols=[f"__p{m}" for m in range(members)], outputCol="probability")
    return PipelineModel([*fitted, mean])
