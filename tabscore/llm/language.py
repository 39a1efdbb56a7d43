"""Language identification by hierarchical discrimination.

A text is first given a language family, by one-versus-one linear support
vector machines over the families; then machines that each separate two
languages of that family vote. Features are the frequencies of hashed byte
n-grams of the whole text, so a text of any length is one pass over its bytes, in pieces.

Common languages have their linguistic family. Other labels learn theirs: the nearest
groups of label centroids join until there are about as many families as the root of
the number of labels, so the machines grow with its power of 1.5, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.tables import crc
from tabscore.llm.words import mix, slices, utf8

# Families of common languages by ISO 639-1 code; other labels learn theirs.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 11  # 2**11 features
TRAIN_ROWS = 8_000  # the bound of the labelled sample that the machines are fitted on
UNDECIDED = "und"
FIT_TASKS = 12
MAX_LABELS = 200  # the bound of labels that are learned, the most frequent first
GRAM_BYTES = 250_000  # text whose n-grams (some 50 bytes for each byte) a task holds at once
ROWS = 256  # texts whose features a task holds at once

# ASCII letters; bytes from 0xC3 on begin letters of the two-byte scripts and beyond.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # digits, signs and white space are one gap
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def grams(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Feature numbers of the n-grams (1 to 3 folded bytes) that end at bytes a to b of texts at ``offsets``, three for each."""
    folded = _FOLD[data[a:b]]
    before = np.concatenate([np.full(max(0, 2 - a), 32, np.uint64), _FOLD[data[max(0, a - 2) : a]]])
    last = np.concatenate([before, folded])
    one, back1, back2 = folded, last[1:-1].copy(), last[:-2].copy()
    begins = offsets[:-1] - a
    for column, at in ((back1, begins), (back2, begins), (back2, begins + 1)):  # the byte before a text is a gap
        column[at[(at >= 0) & (at < b - a)]] = 32
    two = one | (back1 << np.uint64(8)) | np.uint64(1 << 40)
    three = two ^ (back2 << np.uint64(16)) ^ np.uint64(3 << 40)
    keys = np.stack([one, two, three], axis=1).reshape(-1)
    return (mix(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(texts: pa.Array) -> np.ndarray:
    """For each text, the part of each feature in its n-grams; bytes are read in pieces, however long a text is."""
    data, offsets = utf8(texts)
    counts = np.zeros((len(texts), 1 << BITS))
    for a in range(0, len(data), GRAM_BYTES):
        b = min(a + GRAM_BYTES, len(data))
        at, edges = grams(data, offsets, a, b), (np.clip(offsets, a, b) - a) * 3
        for i in np.flatnonzero(np.diff(edges)).tolist():
            counts[i] += np.bincount(at[edges[i] : edges[i + 1]], minlength=1 << BITS)
    counts /= np.maximum(3 * np.diff(offsets), 1)[:, None]
    return counts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (s.slice(k, ROWS) for s in slices(batches, size=GRAM_BYTES) for k in range(0, len(s), ROWS))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        rows = frequencies(part.column("text")) * (1 << BITS)
        flat = pa.ListArray.from_arrays(
            pa.array(np.arange(len(part) + 1, dtype=np.int32) << BITS), pa.array(rows.reshape(-1))
        )
        yield pa.RecordBatch.from_arrays([part.column("lang").cast(pa.string()), flat], ["lang", "x"])


def group_labels(centroids: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Families of labels: listed codes by ``FAMILIES``, others with the labels that are like them.

    Each label that is not listed starts alone. While there are more families than the
    root of the number of labels, rounded up, the two that are most alike (mean cosine of
    the roots of their labels' frequencies) join, listed families never with each other.
    A family is called by its listed name, or by its first label.
    """
    labels = sorted(centroids)
    x = np.sqrt(np.stack([centroids[c] for c in labels]))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    alike = x @ x.T
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(labels):
        groups.setdefault(FAMILY_OF.get(lang, lang), []).append(i)
    limit = math.ceil(math.sqrt(len(labels)))
    while len(groups) > limit:
        free = [
            (-float(alike[np.ix_(groups[a], groups[b])].mean()), a, b)
            for a, b in combinations(sorted(groups, key=lambda g: (g not in FAMILIES, g)), 2)
            if b not in FAMILIES
        ]
        if not free:
            break
        _, a, b = min(free)
        groups[a] += groups.pop(b)
    return {name: sorted(labels[i] for i in own) for name, own in groups.items()}


@dataclass
class Model:
    """Machines by pair of names: weights of the features, and the constant."""

    families: dict[str, list[str]]  # family: its languages
    pairs: list[tuple[str, str, np.ndarray, float]]  # families come first, then languages

    @property
    def languages(self) -> list[str]:
        return sorted(x for names in self.families.values() for x in names)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, max_iter: int = 25, max_labels: int = MAX_LABELS) -> Model:
    """Fit the machines on a sample of about ``train_rows`` texts, the same number from each language.

    A row is in the sample by a hash of its doc_id and text; rows without text or
    label are left out. Labels beyond the ``max_labels`` most frequent (ties by name) are not
    learned. Predictions cover all rows.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_labels)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return Model({}, [])
    each = max(1, train_rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.filter(at < F.element_at(share, F.col("lang"))).select("text", "lang")
    # each step of a fit is a job over the sample, which is small: few tasks
    points = sample.repartition(FIT_TASKS).mapInArrow(_features, "lang string, x array<double>").select(
        "lang", array_to_vector("x").alias("features")
    )
    points = points.persist()
    means = points.groupBy("lang").agg(Summarizer.mean(F.col("features")).alias("mean"))
    families = group_labels({r["lang"]: r["mean"].toArray() for r in means.collect()})  # one for each label

    def machine(a: str, b: str, left: list[str], right: list[str]) -> tuple[str, str, np.ndarray, float]:
        two = points.filter(F.col("lang").isin(left + right)).select(
            "features", F.col("lang").isin(left).cast("double").alias("label")
        )
        svm = LinearSVC(maxIter=max_iter, regParam=1e-4, standardization=False, aggregationDepth=2).fit(two)
        return a, b, svm.coefficients.toArray() * (1 << BITS), svm.intercept

    pairs = [machine(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    for names in families.values():
        pairs += [machine(a, b, [a], [b]) for a, b in combinations(names, 2)]
    points.unpersist()
    return Model(families, pairs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all rows; see ``identify``."""
    numbers = {(a, b): k for k, (a, b, _, _) in enumerate(model.pairs)}
    weights = np.stack([w for _, _, w, _ in model.pairs]) if model.pairs else np.zeros((0, 1 << BITS))
    constants = np.array([constant for *_, constant in model.pairs])
    columns = docs.columns

    def votes(names: list[str], x: np.ndarray) -> np.ndarray:
        """For each text, the part of each name: the product of its machines' logistic values."""
        parts = np.ones((len(x), len(names)))
        places = list(combinations(range(len(names)), 2))
        if places:
            own = [numbers[names[i], names[j]] for i, j in places]
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ weights[own].T + constants[own]), -30, 30)))
            for k, (i, j) in enumerate(places):
                parts[:, i] *= p[:, k]
                parts[:, j] *= 1 - p[:, k]
                if k % 8 == 7:  # products of many parts stay in range
                    parts /= parts.max(axis=1, keepdims=True)
        return parts / parts.sum(axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, languages = sorted(model.families), model.languages
        for part in _parts(batches):
            n = len(part)
            text = part.column("text")
            probability = np.zeros((n, len(languages)))
            if families:
                x = frequencies(text)
                outer = votes(families, x)
                best = outer.argmax(axis=1)
                for i in np.unique(best).tolist():
                    rows, names = np.flatnonzero(best == i), model.families[families[i]]
                    own = [languages.index(lang) for lang in names]
                    probability[np.ix_(rows, own)] = outer[rows, i : i + 1] * votes(names, x[rows])
            letters = pa.compute.fill_null(pa.compute.match_substring_regex(text.cast(pa.large_string()), r"\pL"), False)
            known = letters.to_numpy(zero_copy_only=False) & bool(languages)
            choice = probability.argmax(axis=1) if languages else np.zeros(n, int)
            name = np.where(known, np.array(languages or [UNDECIDED], object)[choice], UNDECIDED)
            value = np.where(known, probability.max(axis=1, initial=0), 0.0)
            arrays = [part.column(c) for c in columns] + [pa.array(name, pa.string()), pa.array(value)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out():
    """Documents that no machine learns from: CRC-32 of doc_id as text is 0 modulo 5."""
    return crc("doc_id") % 5 == 0


def identify(docs: DataFrame, keep: list[str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Columns ``keep`` of all rows with ``lang_pred`` and ``score`` (0 to 1).

    Learns from rows that are not held out and have text and label; lang, source
    and doc_id are no inputs of a prediction. A text that is null or has no letter gets ``und``
    and 0. Repeated rows keep their number; with no labelled row all are ``und``.
    An empty table gives no rows. Equal votes go to the first name. Columns of
    ``keep`` that are named like the two results are replaced by them.
    """
    model = fit(docs.filter(~held_out()), train_rows)
    kept = [c for c in dict.fromkeys([*keep, "text"]) if c not in ("lang_pred", "score")]
    return predict(docs.select(*kept), model)
