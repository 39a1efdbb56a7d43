import math
import random

import numpy as np
import pytest

from tabscore.llm import near_vector
from tests.llm.fixtures import group


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, copy int").repartition(3)


def vectors():
    rng = random.Random(5)

    def random_unit():
        return [rng.gauss(0, 1) for _ in range(16)]

    rows, i = [], 0
    for _ in range(25):
        centre = random_unit()
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, [x + rng.gauss(0, 0.16) for x in centre]))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, [2 * x for x in rows[0][1]]), (i + 2, rows[1][1]), rows[4]]
    rows += [(i + 3, None), (i + 4, []), (i + 5, [0.0] * 16), (i + 6, [1.0, None] + [0.0] * 14), (i + 7, [math.nan] + [1.0] * 15)]
    rows += [(i + 8, [math.inf] + [1.0] * 15), (i + 9, [1.0, 0.0]), (i + 10, [1.0, 0.01]), (None, rows[2][1])]
    return rows


def brute(rows, threshold):
    units = []
    for _, v in rows:
        x = np.array([np.nan if e is None else np.float32(e) for e in v or []], float)
        units.append(x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(len(rows))
        if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
        and units[i] @ units[j] >= threshold
    ]
    root = group(len(rows), links)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[root[i]] = min(least.get(root[i], vec_id), vec_id)
    degree = np.bincount([i for i, _ in links], minlength=len(rows))
    return sorted((str(r[0]), int(degree[i]), str(least[root[i]])) for i, r in enumerate(rows))


@pytest.mark.parametrize("cell, block, margin", [(500, 1000, None), (10, 4, 1.0), (1000, 7, None)])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, cell, block, margin):
    monkeypatch.setattr(near_vector, "CELL", cell)
    monkeypatch.setattr(near_vector, "BLOCK", block)
    out = near_vector.near_duplicates(table(spark, vectors()), margin=margin).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(vectors(), 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_recall_of_the_default_margin(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, 0.95)
    got = near_vector.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    links = sum(n for _, n, _ in want)
    assert links >= sum(r.n_links for r in got) >= 0.999 * links


def low_rank(rank, n, seed):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0][:rank]
    return (rng.normal(size=(n, rank)) @ turn).tolist()


@pytest.mark.parametrize("rank, cell", [(4, 25), (8, 25)])
def test_no_link_is_lost_among_vectors_of_low_rank(spark, monkeypatch, rank, cell):
    """A hundred cells of vectors that differ in the directions in which the centres do."""
    monkeypatch.setattr(near_vector, "CELL", cell)
    rows = list(enumerate(low_rank(rank, 2500, rank)))
    unit = np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vector.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(2500)] == want.tolist() and want.sum() > (10_000 if rank == 4 else 100)


def clusters(n, seed):
    """Vectors in groups of eight near ones, in all directions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 32))
    return (np.repeat(centres, 8, axis=0) + rng.normal(size=(n // 8 * 8, 32)) * 0.22).tolist()


def crowd(n, seed):
    """Vectors around one direction, so near each other that no split helps."""
    rng = np.random.default_rng(seed)
    return (np.eye(32)[0] + rng.normal(size=(n, 32)) * 0.03).tolist()


def tree(monkeypatch, cell=10, fan=4, split=30, deal=100, block=25):
    for name, value in {"CELL": cell, "FAN": fan, "SPLIT": split, "DEAL": deal, "BLOCK": block}.items():
        monkeypatch.setattr(near_vector, name, value)


@pytest.mark.parametrize(
    "vectors, margin",
    [(clusters(1200, 3), None), (low_rank(8, 900, 4), None), (clusters(400, 7) + crowd(300, 8), 1.0)],
)
def test_links_in_a_tree_of_cells_are_those_of_all_pairs(spark, monkeypatch, vectors, margin):
    tree(monkeypatch)
    rows = list(enumerate(vectors))
    out = near_vector.near_duplicates(table(spark, rows), margin=margin).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows, 0.95)


def distinct(spark, vectors):
    return spark.createDataFrame(
        [(i.to_bytes(16), 1, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in enumerate(vectors)],
        "copy binary, n long, v array<double>",
    ).repartition(3)


def test_cells_stay_small_as_vectors_grow(spark, monkeypatch):
    """At three times the rows cells are no larger (one stays whole if a split wouldn't pay), and a vector is in as few of them."""
    tree(monkeypatch)
    copies = []
    for n in (800, 2400):
        found = near_vector._cells(near_vector.Scratch(spark, "cells"), distinct(spark, clusters(n, n)), n, 32, 0.95, 0.2)
        rows = found.select("cell", "home", "homes", "copy").collect()
        assert len({bytes(r.copy) for r in rows if r.home}) == sum(r.home for r in rows) == n
        assert max(r.homes for r in rows) <= 2 * near_vector.SPLIT
        assert len({r.cell for r in rows}) > n / 40
        copies.append(len(rows) / n)
    assert copies[1] < 1.5 * copies[0] < 12


def test_a_crowd_is_not_split_in_vain(spark, monkeypatch):
    tree(monkeypatch)
    found = near_vector._cells(near_vector.Scratch(spark, "cells"), distinct(spark, crowd(500, 9)), 500, 32, 0.95, None)
    rows = found.select("home", "copy").collect()
    assert sum(r.home for r in rows) == 500 and len(rows) <= 4 * 500


def test_directions():
    rng = np.random.default_rng(1)
    assert 60 < near_vector.directions(rng.normal(size=(5000, 64))) < 64
    assert 3.9 < near_vector.directions(np.array(low_rank(4, 5000, 2))) <= 4.01
    assert near_vector.directions(np.zeros((5, 3))) == 1.0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_nothing_to_link(spark, rows):
    out = near_vector.near_duplicates(table(spark, rows)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in out] == [(r[0], 0, r[0], True) for r in rows]
