import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabscore.llm import language
from tabscore.llm.words import mix
from tests.llm.fixtures import corpus, documents

SF = "/root/testdata/sf0.01"


def test_held_out_texts_get_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs, ["doc_id", "lang"]).filter(language.held_out())
    total, right = 0, 0
    for r in out.collect():
        assert 0 <= r.score <= 1
        total, right = total + 1, right + (r.lang == r.lang_pred)
    assert total == sum(1 for i in pq.read_table(f"{SF}/documents.parquet")["doc_id"].to_pylist() if _crc(i) % 5 == 0)
    assert right >= 0.97 * total


def _crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_awkward_rows_keep_their_number(spark):
    docs = documents(spark)
    out = language.identify(docs, docs.columns).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in corpus())
    for r in out:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters)
        assert r.lang_pred in {"und", "en", "de"} and 0 <= r["score"] <= 1


def test_the_label_of_a_row_is_no_input(spark):
    docs = documents(spark)
    model = language.fit(docs)
    a = language.predict(docs.select("doc_id", "text"), model)
    b = language.predict(docs.select("doc_id", "text", F.lit("xx").alias("lang")), model).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None, None)]])
def test_without_labels_all_are_undecided(spark, rows):
    assert [r.lang_pred for r in language.identify(documents(spark, rows), ["doc_id"]).collect()] == ["und"] * len(rows)


def test_families_part_first():
    assert language.FAMILY_OF["en"] == language.FAMILY_OF["de"] != language.FAMILY_OF["fr"]


def test_other_labels_learn_their_family():
    rng = np.random.default_rng(1)
    kinds = rng.random((4, 64)) ** 4
    mean = {f"{'pqrs'[i]}{j}": kinds[i] + rng.random(64) * 0.02 for i in range(4) for j in range(4)}
    assert language.group_labels(mean) == {f"{k}0": [f"{k}{j}" for j in range(4)] for k in "pqrs"}
    listed = {"en": kinds[0], "de": kinds[0] + 0.01, "fr": kinds[1], "xx": kinds[1] + 0.02}
    assert language.group_labels(listed) == {"germanic": ["de", "en"], "romance": ["fr", "xx"]}
    assert language.group_labels({"aa": kinds[0]}) == {"aa": ["aa"]}


def test_unlisted_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.concat(F.lit("x-"), "lang"))
    model = language.fit(docs.filter(~language.held_out()))
    assert len(model.families) == 2 and len(model.languages) == 4 and len(model.pairs) < 6
    out = language.predict(docs.filter(language.held_out()).select("lang", "text"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_labels_beyond_the_bound_are_not_learned(spark):
    rows = [(i, f"text number {i} of {lang}", lang, None, None) for i, lang in enumerate(["a"] * 9 + ["b"] * 6 + ["c"] * 6 + ["d"])]
    assert language.fit(documents(spark, rows), max_labels=2).languages == ["a", "b"]


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = pa.array(["", "Zwei Wörter", None, "x", "", "one long text " * 50, "été", "y"])
    whole = language.frequencies(texts)
    for size in (1, 7, 100):
        monkeypatch.setattr(language, "GRAM_BYTES", size)
        assert np.array_equal(language.frequencies(texts), whole)
    assert np.allclose(whole.sum(axis=1), [0, 1, 0, 1, 0, 1, 1, 1])


def brute_votes(text, model):
    """A text's language and score by loops: n-grams, machines, families, then the languages of the best one."""
    data = [b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in text.encode()]
    keys = []
    for i, one in enumerate(data):
        back1, back2 = (data[i - k] if i >= k else 32 for k in (1, 2))
        two = one | back1 << 8 | 1 << 40
        keys += [one, two, two ^ back2 << 16 ^ 3 << 40]
    at = (mix(np.array(keys, np.uint64)) >> np.uint64(64 - language.BITS)).astype(int)
    margin = {(a, b): sum(w[i] for i in at.tolist()) / max(len(at), 1) + c for a, b, w, c in model.pairs}

    def shares(names):
        part = {n: 1.0 for n in names}
        for a, b in combinations(names, 2):
            p = 1 / (1 + math.exp(-4 * margin[a, b]))
            part[a], part[b] = part[a] * p, part[b] * (1 - p)
        return {n: v / sum(part.values()) for n, v in part.items()}

    outer = shares(sorted(model.families))
    family = max(outer, key=outer.get)
    inner = shares(model.families[family])
    best = max(inner, key=inner.get)
    return best, outer[family] * inner[best]


def test_votes_are_those_of_loops_over_bytes(spark):
    rng = np.random.default_rng(5)
    families = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "xx": ["xx"]}
    names = [*combinations(sorted(families), 2), *combinations(families["germanic"], 2), *combinations(families["romance"], 2)]
    pairs = [(a, b, rng.normal(size=1 << language.BITS), rng.normal() / 10) for a, b in names]
    model = language.Model(families, pairs)
    out = language.predict(documents(spark).select("doc_id", "text"), model).collect()
    seen = set()
    for r in out:
        if r.lang_pred == "und":
            continue
        want, score = brute_votes(r.text, model)
        assert r.lang_pred == want and abs(r.score - score) < 1e-4
        seen.add(want)
    assert len(out) == len(corpus()) and len(seen) > 2
