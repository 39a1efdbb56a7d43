"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A window is two neighbouring blocks of as many shingles as a template has; each
block is in two windows, so every place of the template is whole in one window.
A window that holds the share c of a template's n shingles has a similarity of at least
c * n / (2 * n + (1 - c) * n) to it: 0.36 for c = 0.8. Bands of one minwise value each
retrieve the template; ``BANDS`` of them miss such a window with probability
0.64 ** 24 = 0.00002. Retrieved templates are then compared shingle by shingle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabscore.llm.words import SPACE, mix, sequence_hash, slices, utf8, words_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24

# Public notices by which texts state their license.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "all-rights-reserved": "All rights reserved.",
}

# Letters, digits and bytes beyond ASCII make words; signs part them.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def plain(texts: pa.Array) -> pa.Array:
    """Texts with lower-case ASCII letters and a space for each ASCII sign: bytes keep their places."""
    data, offsets = utf8(texts)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_PLAIN[data])]
    ).cast(pa.large_string())


@dataclass
class Template:
    name: str
    k: int  # words of a shingle
    shingles: np.ndarray  # sorted, distinct
    bands: np.ndarray


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A row of scrambled values for each band."""
    return np.stack([mix(shingles ^ seed) for seed in _SEEDS])


def templates_of(texts: dict[str, str]) -> dict[tuple[int, int], list[Template]]:
    """Templates by shingle size and number of shingles; one without a word matches nothing."""
    out = defaultdict(list)
    for name, text in texts.items():
        words = words_of(plain(pa.array([text])))
        n = len(words.hashes)
        if n:
            k = min(SHINGLE, n)
            own = np.unique(sequence_hash(words.hashes, k))
            out[k, len(own)].append(Template(name, k, own, _bands(own).min(axis=1)))
    return dict(out)


def _windows(first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's blocks of n shingles begin and end, and which text each is of."""
    have = np.maximum(np.diff(first) - k + 1, 0)
    blocks = -(-have // n)
    text = np.repeat(np.arange(len(have)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[text] + nth * n
    return begin, np.minimum(begin + n, first[text] + have[text]), text


def _scan(sizes: dict[tuple[int, int], list[Template]], least: float):
    schema = ["doc_id", "license_id", "containment", "start_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(plain(part.column("text")))
            best: dict[tuple[int, str], tuple[float, int]] = {}
            for k in sorted({k for k, _ in sizes}):
                shingles = sequence_hash(words.hashes, k)
                if not len(shingles):
                    continue
                for (size, n), templates in sizes.items():
                    if size != k:
                        continue
                    begin, end, text = _windows(words.first, k, n)
                    if not len(begin):
                        continue
                    pair = np.append((text[1:] == text[:-1]), False)  # a window goes on to the next block
                    hit = {t.name: np.zeros(len(begin), bool) for t in templates}
                    for band, seed in enumerate(_SEEDS):
                        values = mix(shingles ^ seed)
                        low = _least(values, begin, end)
                        low = np.where(pair, np.minimum(low, np.append(low[1:], low[-1:])), low)
                        for t in templates:
                            hit[t.name] |= low == t.bands[band]
                    for t in templates:
                        for w in np.flatnonzero(hit[t.name]).tolist():
                            a, b = begin[w], end[w + 1] if pair[w] else end[w]
                            there = np.isin(shingles[a:b], t.shingles)
                            share = len(np.unique(shingles[a:b][there])) / len(t.shingles)
                            if share >= least:
                                row = int(text[w])
                                start = int(a + np.argmax(there) - words.first[row])
                                old = best.get((row, t.name))
                                if old is None or (-share, start) < (-old[0], old[1]):
                                    best[row, t.name] = share, start
            rows = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()).take(pa.array([r for r, _ in rows], pa.int64())),
                    pa.array([name for _, name in rows], pa.string()),
                    pa.array([best[r][0] for r in rows], pa.float64()),
                    pa.array([best[r][1] for r in rows], pa.int32()),
                ],
                schema,
            )

    return run


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of each block's values; blocks are in order and don't overlap, with gaps between texts."""
    edges = np.stack([begin, end], axis=1).reshape(-1)
    if edges[-1] == len(values):
        edges = edges[:-1]
    return np.minimum.reduceat(values, edges)[::2]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license_id, containment, start_word``: a row for each document and template it holds.

    containment is the share of the template's shingles in the best window (of equal
    ones the first), start_word the place of the first of them. Words are runs of
    letters, digits and non-ASCII bytes, A-Z lower-cased. A template of fewer words than a shingle
    is one shingle. Null and empty texts hold nothing; repeated rows
    give repeated rows; an empty table gives none. Other columns are not read.
    The templates, a small library, go to every task.
    """
    sizes = templates_of(TEMPLATES if templates is None else templates)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scan(sizes, least), "doc_id long, license_id string, containment double, start_word int")


assert SPACE[32]  # signs become a byte that parts words
