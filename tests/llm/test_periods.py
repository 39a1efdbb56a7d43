import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscore.llm import catalog, periods
from tabscore.llm.words import mix
from tests.llm.fixtures import corpus, documents, prose


def brute(words, least=6, times=4):
    """Runs by definition: the longest stretches of every period, with the smallest period of each."""
    best, n = {}, len(words)
    for p in range(1, n // times + 1):
        at = 0
        while at + p < n:
            stop = at
            while stop + p < n and words[stop] == words[stop + p]:
                stop += 1
            if stop + p - at >= max(least, times * p):
                best.setdefault((at, stop + p), p)
            at = stop + 1
    return sorted((a, b, p) for (a, b), p in best.items())


def caught(words, cuts=()):
    hashes = mix(np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64) + np.uint64(1))
    catchers, at = periods.SquareCatchers(), 0
    for cut in [*sorted(cuts), len(words)]:
        catchers.append(hashes[at:cut])
        at = max(at, cut)
    return sorted(map(tuple, catchers.close().tolist()))


@given(st.lists(st.integers(0, 2), max_size=90), st.lists(st.integers(0, 90), max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_words_in_any_portions(words, cuts):
    assert caught(words, [min(c, len(words)) for c in cuts]) == brute(words)


def test_planted_periods_in_any_portions():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.randrange(50) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice([1, 2, 3, 5, 8, 13, 16, 31, 32, 33, 64])
            unit = [rng.randrange(4 if rng.random() < 0.5 else 1000) for _ in range(p)]
            words += (unit * 7)[: rng.randrange(3 * p, 6 * p + 1)] + [rng.randrange(50) for _ in range(rng.randrange(3))]
        want = brute(words)
        assert caught(words) == want
        assert caught(words, range(1, len(words), rng.randrange(1, 40))) == want
        assert caught(words, range(len(words))) == want


def test_words_without_squares_and_hash_twins():
    """A square-free sequence has no run, nor has the overlap-free one on which sums of powers collide."""
    thue = [bin(i).count("1") % 2 for i in range(1 << 13)]
    assert caught(thue) == brute(thue[:64]) == []
    twin = thue[: 1 << 11]
    other = [1 - x for x in twin]
    words = (twin + other) * 2 + twin * 5 + [7]
    assert caught(words) == [(4 * len(twin), 9 * len(twin), len(twin))]


def as_row(doc_id, text):
    words = (text or "").encode().split()
    found = brute(words)
    gone = {i for a, b, p in found for i in range(a + p, b)}
    lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in sorted(found, key=lambda r: (r[0], r[2])))
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(((a - b, a, p) for a, b, p in found), default=None)
    longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], -1000 * top[0] // top[2])
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def planted(doc_id, text):
    """The contract's rows: in a tenth of the documents the words from a on repeat the first p of them."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return b" ".join(words).decode()


def rows_with_runs():
    rng = random.Random(9)
    texts = ["a " * n for n in (4, 5, 6, 7)] + ["x y " * 4, "x y " * 3 + "x", "a a a b " * 9 + "a a a", "é ß\t" * 6, "a\x0ba\x0ca\r\na\na a"]
    texts += [" ".join(prose(rng, 30) for _ in range(3)), "q " * 3000, (prose(rng, 500) + " ") * 5 + "end", "A a " * 4, "\x1c " * 7]
    texts += [prose(rng, rng.randrange(5, 60), 2) for _ in range(40)]
    return [(100 + i, t, None, None, None) for i, t in enumerate(texts)]


def test_documents(spark):
    rows = corpus() + rows_with_runs()
    out = catalog.runs_report(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(as_row(r[0], r[1])) for r in rows)


def test_planted_documents(spark):
    rows = corpus() + rows_with_runs()
    out = catalog.runs_report(catalog.with_periods(documents(spark, rows))).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(as_row(r[0], planted(r[0], r[1]))) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 3


def test_collapsed_text_and_runs(spark):
    found = periods.find_runs(documents(spark, [(1, "so  so so so so so\nmuch", None, None, None), (2, None, None, None, None)]))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert got == {1: (7, [(0, 6, 1)], "so much"), 2: (0, [], "")}


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_slices_change_nothing(spark, monkeypatch, size):
    import tabscore.llm.words as w

    monkeypatch.setattr(w, "SLICE_BYTES", size)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [r[0] for r in rows_with_runs()], "text": [r[1] for r in rows_with_runs()]})
    out = [r for part in periods._scan(6, 4)(iter([batch])) for r in part.to_pylist()]
    assert [(r["doc_id"], len(r["runs"]), r["runs_sha256"]) for r in out] == [(x := as_row(r[0], r[1]))[:2] + x[6:7] for r in rows_with_runs()]


def test_empty_table(spark):
    assert catalog.runs_report(catalog.with_periods(documents(spark, []))).count() == 0
