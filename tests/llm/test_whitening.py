import math
import random

import numpy as np
import pytest

from conftest import SF
from tabscore.llm import catalog, whitening


def table(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, x int, n int, j int, whitened int, values int"
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], schema).repartition(3)


def expected(vectors, components):
    """By the full covariance, from exact integers."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = [int(r) for r in ((n * x - s) ** 2).sum(1)]
    xc = ((n * x - s) / n).astype(float)
    values, q = np.linalg.eigh(xc.T @ xc / n)
    values, q = values[::-1], q[:, ::-1]
    keep = values[:components] > 1e-11 * max(values[0], 0)
    values, q = values[:components][keep], q[:, :components][:, keep]
    return deviation, values, xc @ q / np.sqrt(values), values / np.trace(xc.T @ xc / n)


def check(rows, vectors, components, ids=None):
    """Whitened values equal those of the full covariance, up to the sign of a component and turns among equal eigenvalues."""
    deviation, values, white, explained = expected(vectors, components)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    ids = range(len(vectors)) if ids is None else ids
    assert sorted(by_id) == sorted(set(ids)) if len(values) else not by_id
    assert len(rows) == len(vectors) * len(values)
    got = np.array([[by_id[i][k + 1].whitened for k in range(len(values))] for i in ids])
    assert [by_id[i][1].deviation for i in ids] == deviation
    assert all(r.n == len(vectors) for r in rows)
    np.testing.assert_allclose([by_id[ids[0]][k + 1].explained for k in range(len(values))], explained, rtol=1e-10)
    error = np.abs(np.cov(got.T, bias=True) - np.eye(len(values))).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    assert abs(rows[0].identity_error - error) < 1e-10
    lonely = [k for k in range(len(values)) if all(abs(values[k] - v) > 1e-6 * values[0] for j, v in enumerate(values) if j != k)]
    turn = np.sign((got * white).sum(0))
    np.testing.assert_allclose((got * turn)[:, lonely], white[:, lonely], atol=1e-7)


def gauss(rng, n, d, scales):
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return (rng.normal(size=(n, d)) * scales) @ turn


@pytest.mark.parametrize("kind", ["flat", "steep", "clusters", "low rank", "narrow", "one strong"])
def test_components_are_those_of_the_covariance(spark, kind):
    rng = np.random.default_rng(5)
    vectors = {
        "flat": lambda: gauss(rng, 2000, 48, np.ones(48)),
        "steep": lambda: gauss(rng, 600, 40, 0.7 ** np.arange(40) * 100),
        "clusters": lambda: gauss(rng, 900, 48, np.ones(48) * 0.1) + rng.normal(size=(5, 48))[rng.integers(0, 5, 900)],
        "low rank": lambda: np.round(gauss(rng, 400, 40, np.ones(40))[:, :3]) @ np.eye(3, 40),
        "narrow": lambda: gauss(rng, 50, 7, np.ones(7)),
        "one strong": lambda: gauss(rng, 700, 44, np.array([1000.0] + [1.0] * 43)),
    }[kind]()
    rows = table(spark, list(enumerate(vectors.tolist())))
    found = whitening.by_component(whitening.whiten(rows, components=8, guard=4)).collect()
    check(found, vectors, 8)


class Counted:
    def __init__(self, v):
        self.v, self.widths = v, []

    def __matmul__(self, q):
        self.widths.append(q.shape[1])
        return self.v @ q


@pytest.mark.parametrize("equal", [1, 2, 6, 40])
def test_equal_eigenvalues_and_narrow_blocks(equal):
    rng = np.random.default_rng(equal)
    values = np.sort(rng.uniform(0.5, 1.5, 200))[::-1]
    values[3 : 3 + equal] = values[3]
    values = np.sort(values)[::-1]
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    v = Counted((turn * values) @ turn.T)
    got, q = whitening.leading_components(v, 200, 8)
    np.testing.assert_allclose(got, values[:8], rtol=1e-12)
    np.testing.assert_allclose(q.T @ q, np.eye(8), atol=1e-13)
    assert np.linalg.norm(v.v @ q - q * got) < 1e-11
    assert max(v.widths) < 100  # never the whole matrix


def test_the_filter_is_the_polynomial():
    """On a diagonal operator each entry grows by T((x - centre) / half), scaled to 1 at the top."""
    x = np.linspace(0, 4, 9)
    got = whitening.chebyshev(np.diag(x), np.ones((9, 1)), 0.5, 2.0, 4.0, 5, np.zeros((9, 0)))[:, 0]
    t = np.polynomial.chebyshev.Chebyshev.basis(5)
    want = t((x - 1.25) / 0.75)
    np.testing.assert_allclose(got, want / t((4 - 1.25) / 0.75), atol=1e-12)


def test_what_is_not_certified_raises(monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    monkeypatch.setattr(whitening, "DEGREE", 1)
    with pytest.raises(ArithmeticError, match="not certified"):
        whitening.leading_components(np.diag(np.linspace(1, 2, 100)), 100, 8)


def test_awkward_rows(spark):
    rng = random.Random(2)
    good = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    good += [good[0], good[0], [-3.0, 0.0, 0.0, 0.0, 1e6]]
    ids = [*range(30), 0, 0, None]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf] + [0.0] * 4, [None] * 5]
    rows = table(spark, [*zip(ids, good, strict=True), *((100 + i, v) for i, v in enumerate(bad)), (200, [1.0, 2.0]), (201, [2.0, 2.0])])
    found = whitening.by_component(whitening.whiten(rows)).collect()
    five = [r for r in found if r.n == 33]
    deviation, values, white, _ = expected(good, 32)
    assert len(five) == 33 * len(values) and {r.vec_id for r in five} == {*range(30), None}
    assert sorted(r.deviation for r in five if r.component == 1) == sorted(deviation)
    first = sorted(abs(r.whitened) for r in five if r.component == 1)
    np.testing.assert_allclose(first, sorted(np.abs(white[:, 0])), atol=1e-9)
    two = [(r.vec_id, r.component, abs(r.whitened), r.explained, r.deviation) for r in found if r.n == 2]
    assert sorted(two) == [(200, 1, 1.0, 1.0, 64 * 64), (201, 1, 1.0, 1.0, 64 * 64)]


def test_large_counts_have_exact_deviations():
    fit = whitening.Fit(10**10, [10**16 + 7, 10**16 - 5], values=np.ones(1), vectors=np.ones((2, 1)))
    import pyarrow as pa

    x = [[1_000_003, 999_000], [1_000_000, 1_000_000]]
    batch = pa.RecordBatch.from_pydict({"vec_id": [1, 2], "x": pa.array(x, pa.list_(pa.int64()))})
    (out,) = whitening._scores(fit)(iter([batch]))
    want = [sum((10**10 * e - s) ** 2 for e, s in zip(row, fit.sums)) for row in x]
    assert [int(v) for v in out.column("deviation").to_pylist()] == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(table(spark, rows))
    assert [(r.vec_id, r.deviation, r.whitened, r.identity_error) for r in out.collect()] == [(i, 0, [], 0.0) for i, v in rows if v]
    assert whitening.by_component(out).count() == 0


def test_an_entry_without_exact_sums_raises(spark):
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(table(spark, [(1, [1e30])])).collect()


def test_query(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    found = catalog.op11_chebyshev_subspace(spark, SF).collect()
    check(found, [r.embedding for r in given], 32, [r.vec_id for r in given])
