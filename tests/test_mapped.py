"""The SVM on mapped features against Spark ML's on the stored vectors."""

from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.models import mapped, svm


def table(spark, n=500):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2)) + np.where(rng.random((n, 1)) < 0.4, 3.0, 0.0)
    y = ((x**2).sum(1) < 3) ^ (rng.random(n) < 0.05)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, target int").repartition(3)


@pytest.mark.parametrize("width, degree", [(1, 1), (3, 2), (2, 4)])
def test_monomials(width, degree):
    x = np.random.default_rng(1).normal(size=(5, width))
    got = mapped.Monomials(width, degree)
    want = [x[:, list(c)].prod(1) for d in range(1, degree + 1) for c in combinations_with_replacement(range(width), d)]
    np.testing.assert_allclose(got(x), np.column_stack(want))
    assert got.size == len(want)


def test_minimum_of_a_bowl():
    scale = np.array([1.0, 10.0, 100.0])
    got = mapped.minimize(lambda x: (float((scale * (x - 1) ** 2).sum()), 2 * scale * (x - 1)), np.zeros(3), 50, 1e-12)
    np.testing.assert_allclose(got, 1, atol=1e-4)


@pytest.mark.parametrize("options", [{"kernel": "gaussian", "features": 12, "gamma": 0.5}, {"kernel": "polynomial", "degree": 3}])
def test_loss_is_that_of_the_stored_vectors(spark, monkeypatch, options):
    """The same loss at the weights that Spark ML finds on the stored vectors, and no greater one at the end."""
    seen, minimize = [], mapped.minimize
    monkeypatch.setattr(mapped, "minimize", lambda loss, *rest: seen.append((loss, out := minimize(loss, *rest))) or out)
    monkeypatch.setattr(svm, "discard", lambda df: None)  # the loss is asked for again
    df = table(spark)
    model = svm.kernel_svm_approx(df, ["a", "b"], k=3, reg=0.01, max_iter=30, **options)
    loss, found = seen[0]
    last = model.stages[-2]
    clustered = model.stages[1].transform(model.stages[0].transform(df)).select("a", "b", "target", "__cluster").toPandas()
    v = last.map()(clustered[["a", "b"]].to_numpy())
    hot = clustered["__cluster"].to_numpy()[:, None] == np.arange(3)
    vectors = np.hstack([v, (hot[:, :, None] * v[:, None, :]).reshape(len(v), -1)])
    stored = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(vectors, clustered["target"])], "x array<double>, target double")
    stored = stored.select(array_to_vector(F.col("x")).alias("features"), "target")
    plain = LinearSVC(labelCol="target", regParam=0.01, maxIter=30).fit(stored)
    at = plain.coefficients.toArray() * vectors.std(0, ddof=1)
    centre = float(plain.coefficients.toArray() @ vectors.mean(0))
    want = plain.summary().objectiveHistory[-1]
    value, grad = loss(np.append(at, plain.intercept + centre))
    assert value == pytest.approx(want, rel=1e-6)
    assert loss(found)[0] <= 1.01 * want
    # the gradient, by differences
    point = found + 0.01
    base, grad = loss(point)
    for i in (0, len(v[0]) + 1, len(point) - 1):
        step = np.eye(len(point))[i] * 1e-7
        assert (loss(point + step)[0] - loss(point - step)[0]) / 2e-7 == pytest.approx(grad[i], abs=1e-4)


@pytest.mark.parametrize("options", [{"kernel": "gaussian", "features": 40}, {"kernel": "polynomial", "degree": 3}])
def test_mapped_rows_are_not_stored(spark, tmp_path, monkeypatch, options):
    """What is kept of a row are its plain features; a saved model scores alike."""
    kept, materialize = [], svm.materialize

    class Stored(LinearSVC):
        def fit(self, *args):
            raise AssertionError("keeps the mapped vector of every row")

    monkeypatch.setattr(svm, "LinearSVC", Stored)
    monkeypatch.setattr(svm, "materialize", lambda df, name="table": kept.append(df.columns) or materialize(df, name))
    df = table(spark)
    model = ts.kernel_svm_approx(df, ["a", "b"], k=2, **options)
    assert kept == [["cluster", "y", "x0", "x1"]]
    scored = model.transform(df)
    assert scored.columns == [*df.columns, "prediction"]
    ts.save_model(model, f"{tmp_path}/m")
    again = ts.load_model(f"{tmp_path}/m").transform(df)
    assert sorted(scored.collect()) == sorted(again.collect())


def test_constant_features_and_few_points(spark):
    rows = [(i, 0.1, float(i % 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b double, target int")
    model = ts.kernel_svm_approx(df, ["a", "b"], k=5, kernel="polynomial")
    assert all(r["prediction"] == r["target"] for r in model.transform(df).collect())
