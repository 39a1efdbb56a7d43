import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscore.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbZ \t\n\x0b\x0c\r\x1c\xa0é　ß"), max_size=12)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    found = W.words_of(pa.array(texts, pa.string()))
    raw = found.data.tobytes()
    got = [raw[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]
    want = [w for t in texts for w in (t or "").encode().split()]
    assert got == want
    assert found.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    by_hash = {}
    for w, h in zip(want, found.hashes.tolist(), strict=True):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_lower_case_is_ascii_only():
    a = W.words_of(pa.array(["ABC É"]), lower=True).hashes
    b = W.words_of(pa.array(["abc É"])).hashes
    assert (a == b).all()
    assert a[1] != W.words_of(pa.array(["é"])).hashes[0]


def test_sequences_are_equal_only_if_their_words_are():
    rng = random.Random(1)
    values = W.mix(np.array([rng.randrange(3) for _ in range(300)], np.uint64))
    for k in (1, 2, 5):
        h = W.sequence_hash(values, k)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(tuple(values[i : i + k]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
        begin = np.arange(len(h))
        assert (W.span_hash(values, begin, np.full(len(h), k)) == h).all()


def test_slices_hold_all_rows_and_bounded_bytes(monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 50)
    batch = pa.record_batch({"text": ["x" * n for n in [10, 0, 30, 200, 5, 5]] + [None], "i": list(range(7))})
    parts = list(W.slices(iter([batch])))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(7))
    assert len(parts) > 1 and all(len(p) for p in parts)


@pytest.mark.parametrize("texts", [[], [None], [""], [None, "", " "]])
def test_no_words(texts):
    found = W.words_of(pa.array(texts, pa.string()))
    assert len(found.hashes) == 0 and found.first.tolist() == [0] * (len(texts) + 1)


def test_powers_of_a_long_text_are_not_kept(monkeypatch):
    monkeypatch.setattr(W, "KEPT_POWERS", 1 << 17)
    monkeypatch.setattr(W, "_kept", W._powers(1 << 16))
    first = [x.tolist() for x in W.powers(1000)]
    up, down = W.powers(70_000)
    assert len(W._kept[0]) == 1 << 17 and len(up) == len(down) == 70_000
    up, down = W.powers(200_000)
    assert len(W._kept[0]) == 1 << 17 and len(up) == len(down) == 200_000
    assert [x[:1000].tolist() for x in (up, down)] == first
    assert (up * down == 1).all() and (up[2:] == up[1:-1] * up[1]).all()
