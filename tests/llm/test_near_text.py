import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tabscore.llm import near_text
from tests.llm.fixtures import corpus, documents, group, words


def brute(rows, k, percent):
    sets = []
    for r in rows:
        w = words(r[1], lower=True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [
        (i, j)
        for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = group(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(
        (str(r[0]), len(sets[i]), str(least.get(root[i]) if sets[i] else r[0])) for i, r in enumerate(rows)
    )


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, k, percent):
    assert found(near_text.near_duplicates(documents(spark), k, percent)) == brute(corpus(), k, percent)


def test_crowded_nodes_are_compared_too(spark, monkeypatch):
    monkeypatch.setattr(near_text, "NODE", 4)
    monkeypatch.setattr(near_text, "DEPTH", 2)
    df = near_text.near_duplicates(documents(spark), 3, 85)
    assert found(df) == brute(corpus(), 3, 85)


def test_one_representative_for_each_component(spark):
    rows = [r for r in corpus() if r[3] != "s1"]  # without the doc_id of two texts
    out = near_text.near_duplicates(documents(spark, rows), 3, 85).collect()
    by_component = {}
    for r in out:
        if r.n_shingles and r.representative and r.component_id is not None:
            by_component.setdefault(r.component_id, set()).add((r.doc_id, r.text_hash))
    assert all(len(v) == 1 for v in by_component.values())
    assert {r.component_id for r in out if r.n_shingles and r.component_id is not None} == set(by_component)


def test_an_empty_table(spark):
    assert near_text.near_duplicates(documents(spark, [])).count() == 0


def altered(rng, text, n, tag):
    """A text with ``n`` of its words replaced by new ones, none beside another."""
    for i, at in enumerate(rng.sample(range(1, len(text) // 4), n)):
        text = [*text[: 4 * at], f"{tag}x{i}", *text[4 * at + 1 :]]
    return text


def test_links_inside_a_crowd_just_below_the_threshold(spark, monkeypatch):
    """Pages of one template, at 0.75 to 0.83 to each other, that hold pairs and chains just over 0.85."""
    monkeypatch.setattr(near_text, "DEPTH", 2)
    rng = random.Random(2)
    template = [f"t{i}" for i in range(200)]
    pages = [altered(rng, template, 4, f"p{i}") for i in range(300)]
    for i in range(60):
        pages.append(altered(rng, pages[i], 5, f"c{i}"))
    for i in range(60, 90):  # base - light copy - heavier copy
        light = altered(rng, pages[i], 2, f"l{i}")
        pages += [light, altered(rng, light, 5, f"h{i}")]
    rows = [(i, " ".join(p), "en", "s0", 1) for i, p in enumerate(pages)]
    want = brute(rows, 3, 85)
    assert 150 < len({c for _, _, c in want}) < 300
    assert found(near_text.near_duplicates(documents(spark, rows), 3, 85)) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_hold_pairs_at_the_threshold_at_every_depth(spark, monkeypatch, percent):
    """Pairs just over the threshold that meet nowhere above the last depth, as no node of two is small."""
    monkeypatch.setattr(near_text, "NODE", 1)
    rng = random.Random(percent)
    n = 1
    while 100 * (198 - 3 * n - 3) >= percent * (198 + 3 * n + 3):
        n += 1
    pages = []
    for i in range(150):
        page = [f"p{i}w{j}" for j in range(200)]
        pages += [page, altered(rng, page, n, f"c{i}")]
    rows = [(i, " ".join(p), "en", "s0", 1) for i, p in enumerate(pages)]
    want = brute(rows, 3, percent)
    assert len({c for _, _, c in want}) == 150
    assert found(near_text.near_duplicates(documents(spark, rows), 3, percent)) == want


def test_a_batch_of_large_sets_is_confirmed_in_slices():
    """Sets of 24 MB on each side: the same links as all at once, and a few of them in memory at a time."""
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(1 << 40, 2000, replace=False).astype(np.uint64)) for _ in range(40)]
    near = [s[: 2000 - 20 * i] for i, s in enumerate(sets)]
    at = [i % 40 for i in range(1500)]
    batch = pa.record_batch(
        {
            "a": [b"a%d" % i for i in range(1500)],
            "b": [b"b%d" % i for i in range(1500)],
            "x": [sets[i].tobytes() for i in at],
            "y": [near[i].tobytes() for i in at],
        }
    )
    tracemalloc.start()
    out = pa.Table.from_batches(list(near_text._confirm(85)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("a").to_pylist() == [b"a%d" % i for i, k in enumerate(at) if 2000 - 20 * k >= 1700]
    assert out.column("b").to_pylist() == [b"b%d" % i for i, k in enumerate(at) if 2000 - 20 * k >= 1700]
    assert peak < 10_000_000, peak
