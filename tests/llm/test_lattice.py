import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabscore.llm import lattice
from tests.llm.fixtures import corpus, documents, words


def marginal(text: bytes, score: dict[bytes, float]) -> float:
    """The sum over all segmentations, by listing them."""
    if not text:
        return 1.0
    return sum(10 ** score[text[:i]] * marginal(text[i:], score) for i in range(1, len(text) + 1) if text[:i] in score)


def small_lattice():
    rng = random.Random(2)
    pieces = [b" ", b"a", b"b", b"c", b"ab", b"bc", b" a", b"abc", b" ab", b"cc", b"ccc"]
    return lattice.Lattice(pieces, np.array([-rng.random() * 3 for _ in pieces]))


def test_a_words_probability_is_the_sum_over_its_segmentations():
    lat = small_lattice()
    rng = random.Random(4)
    every = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [b"", b"x", b"abx"]
    got = lat.words(every)
    for w, g in zip(every, got, strict=True):
        want = marginal(b" " + w, lat.by_piece)
        assert (g == -np.inf and want == 0) or abs(g - math.log10(want)) < 1e-9
        assert g == lat.one(w) or abs(g - lat.one(w)) < 1e-9


def test_long_words_take_the_same_recursion(monkeypatch):
    lat = small_lattice()
    word = b"abcab" * 30
    long = lat.words([word])[0]
    monkeypatch.setattr(lattice, "WIDE", 10_000)
    assert abs(lat.words([word])[0] - long) < 1e-6


def test_byte_planes_round_trip():
    codes = np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert lattice._unpack(lattice._pack(codes)).tolist() == codes.tolist()
    assert lattice._unpack(lattice._pack(codes[:0])).tolist() == []


@pytest.mark.parametrize("block", [16_000_000, 400])
def test_base_and_counts_are_those_of_the_contract(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
    rows = corpus()
    tokens = [[*words(r[1], lower=True), None] for r in rows]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for r in rows]
    count = Counter(t for own, h in zip(tokens, held, strict=True) if not h for t in own)
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[t] + 1) / (n + (v + 1))) for t in own) for own in tokens]
    want = sorted(
        (str(r[0]), h, len(own), sum(count[t] > 0 for t in own), n, round(b, 6))
        for r, h, own, b in zip(rows, held, tokens, base, strict=True)
    )
    out = lattice.score_documents(documents(spark), lattice.vocabulary_path()).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_scores_are_those_of_the_estimated_pieces(spark):
    pieces = lattice.read_pieces(lattice.vocabulary_path())
    rows = corpus()
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for r in rows]
    encoder = lattice._encoder(pieces)
    count = np.full(len(pieces), lattice.ALPHA)
    for r, h in zip(rows, held, strict=True):
        for w in [] if h else words(r[1], lower=True):
            for i in encoder.encode_ordinary(" " + w.decode()):
                count[i] += 1
    ends = held.count(False)
    mass = count.sum() + ends + lattice.ALPHA
    lat = lattice.Lattice(pieces, np.log10(count / mass))
    out = {}
    for r in lattice.score_documents(documents(spark), lattice.vocabulary_path()).collect():
        out.setdefault(str(r.doc_id), []).append(r.score)
    for r in rows:
        own = words(r[1], lower=True)
        want = sum(lat.words(own)) + math.log10((ends + lattice.ALPHA) / mass) if len(own) < 200 else None
        if want is not None:
            assert min(abs(s - want) for s in out[str(r[0])]) < 1e-5 * max(1, abs(want))


def test_every_byte_is_a_piece():
    assert {bytes([b]) for b in range(256)} <= set(lattice.read_pieces(lattice.vocabulary_path()))


def test_an_empty_table_and_no_training_rows(spark):
    assert lattice.score_documents(documents(spark, []), lattice.vocabulary_path()).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = lattice.score_documents(documents(spark, [(i, "a b", None, None, None)]), lattice.vocabulary_path()).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0)]


def test_blocks_are_in_the_order_of_their_rows():
    batch = pa.record_batch({"doc_id": [1, None, 2], "held_out": [False, True, False], "text": ["b a b", None, "c"]})
    out = list(lattice._blocks(iter([batch])))
    assert len(out) == 1
    row = out[0].to_pylist()[0]
    assert row["doc_ids"] == [1, None, 2] and row["edges"] == [0, 3, 3, 4]
    assert [row["words"][c] for c in lattice._unpack(row["codes"])] == [b"b", b"a", b"b", b"c"]


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_blocks_that_look_alike_keep_their_own_words(spark, parts):
    """Blocks of the same first document, numbers of documents and words, and first word."""
    rows = [(1, "alpha beta", None, None, None), (1, "alpha gamma", None, None, None), (3, "beta beta beta delta", None, None, None)]
    out = lattice.score_documents(documents(spark, rows).repartitionByRange(parts, "text"), lattice.vocabulary_path()).collect()
    found = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 3)) for r in out}
    one = lattice.score_documents(documents(spark, rows).coalesce(1), lattice.vocabulary_path()).collect()
    assert len(out) == 3 and len(found) == 3
    assert found == {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 3)) for r in one}


def test_null_and_repeated_ids_one_row_in_a_partition(spark):
    rows = [(i, f"w{n} x", None, None, None) for n, i in enumerate([None, None, None, 7, 7, 7, 7, None])]
    df = documents(spark, rows)
    spread = spark.createDataFrame(spark.sparkContext.parallelize(df.collect(), len(rows)), df.schema)
    assert spread.rdd.getNumPartitions() == len(rows)
    got, want = (
        sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lattice.score_documents(x, lattice.vocabulary_path()).collect())
        for x in (spread, df.coalesce(1))
    )
    assert got == want
