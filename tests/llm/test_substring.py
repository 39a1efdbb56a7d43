import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabscore.llm import substring
from tabscore.llm.words import words_of
from tests.llm.fixtures import corpus, documents, words


def brute(rows, window):
    split = [words(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(r[0]), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, window, **options):
    repeats = substring.find_repeats(docs, window, **options)
    cut = {(r.doc_id, r.text_hash): r for r in substring.cut_repeats(repeats).collect()}
    out = []
    for r in repeats.scanned.collect():
        c = cut.get((r.doc_id, r.text_hash))
        sha = r.whole_sha256 if c is None else hashlib.sha256(c.kept.encode()).hexdigest()
        out.append((str(r.doc_id), r.n_words, c.n_removed if c else 0, sha))
    return sorted(out)


@pytest.mark.parametrize("window, seed", [(35, 14), (12, 5), (3, 14)])
def test_removed_words_are_those_of_repeated_windows(spark, window, seed):
    assert found(documents(spark), window, seed=seed) == brute(corpus(), window)


def test_groups_that_do_not_fit_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 3)
    assert found(documents(spark), 35) == brute(corpus(), 35)


def test_subtrees_are_those_of_all_suffixes():
    """Suffixes in order of their words' ranks; the depth above each is its longest match with any other."""
    rng = random.Random(3)
    for window in (1, 2, 5):
        texts = [" ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(0, 25))) for _ in range(12)]
        texts += [texts[3], texts[4] + " w9", "a " * 20, ""]
        found = words_of(pa.array(texts))
        split = [t.split() for t in texts]
        suffixes = {int(found.first[i]) + j: w[j:] for i, w in enumerate(split) for j in range(len(w) - window + 1)}

        def match(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        want = {p: max(match(s, t) for q, t in suffixes.items() if q != p) for p, s in suffixes.items()}
        at, depth = substring.deepest(found, window)
        assert dict(zip(at.tolist(), depth.tolist())) == {p: d for p, d in want.items() if d >= window}
        assert (np.diff(at) > 0).all()
        order, between = substring.subtree(found, window)
        assert sorted(order.tolist()) == sorted(suffixes)
        assert between.tolist() == [match(suffixes[a], suffixes[b]) for a, b in zip(order.tolist()[:-1], order.tolist()[1:])]


def test_a_batch_of_many_groups_is_grown_in_portions(monkeypatch):
    """One batch of 10,000 pieces: the same spans as group by group, in a part of the memory."""
    rng = random.Random(5)
    rows = []
    for key in range(2000):
        base = [f"k{key}w{j}" for j in range(50)]
        for copy in range(5):
            rows.append((key, 5 * key + copy, copy, " ".join(base[: rng.randrange(30, 50)]).encode()))
    key, doc, start, text = zip(*rows, strict=True)
    batch = substring._rows(key, doc, doc, start, [1] * len(rows), text)
    heads = [5 * k for k in range(2000)]
    alone = [b for a in heads for b in substring._subtrees(35)(iter([batch.slice(a, 5)]))]
    tracemalloc.start()
    together = list(substring._subtrees(35)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.Table.from_batches(together).equals(pa.Table.from_batches(alone))
    size = sum(map(len, text))
    assert size > 3_000_000 and peak < 30 * size, (size, peak)
    sizes = [(len(t), t.column("key").unique().to_pylist()) for t in substring.portions(iter([batch]))]
    assert len(sizes) >= size // substring.SLICE_BYTES and sum(n for n, _ in sizes) == len(rows)
    assert sum(len(k) for _, k in sizes) == 2000  # no group is divided
    monkeypatch.setattr(substring, "SLICE_BYTES", 1)
    assert [len(t) for t in substring.portions(iter([batch]))] == [5] * 2000


def test_maximal_repeats_are_the_spans(spark):
    """A passage of 50 words in three texts and one of 40 in two, side by side: one span each, whole."""
    rng = random.Random(4)
    long, other = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(n)) for c, n in (("p", 50), ("q", 40)))
    fill = [" ".join(f"f{i}x{j}" for j in range(20)) for i in range(8)]
    rows = [f"{fill[0]} {long} {fill[1]}", f"{fill[2]} {long} {fill[3]} {other}", f"{long} {fill[4]} {other} {fill[5]}", f"{fill[6]} {fill[7]}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    marked = substring.find_repeats(docs, 35).marked.collect()
    got = {}
    for r in marked:
        gone = substring.covered(len(r.text.split()), r.spans)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        got[r.doc_id] = edges.reshape(-1, 2).tolist()
    assert got == {0: [[20, 70]], 1: [[20, 70], [90, 130]], 2: [[0, 50], [70, 110]]}


def test_an_empty_table(spark):
    assert found(documents(spark, []), 35) == []
