"""Words of whole texts as numpy columns: positions, 64-bit hashes, shingle hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text. All texts of a
slice are handled at once; a slice holds about a megabyte (or one longer text),
so a task's memory does not depend on its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
KEPT_POWERS = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept = _powers(1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64.

    One table serves all slices of the usual size; what a longer text needs is not kept.
    """
    global _kept
    found = _kept
    if n > len(found[0]):
        size = 1 << (int(n) - 1).bit_length()
        found = _powers(size if size <= KEPT_POWERS else int(n))
        if size <= KEPT_POWERS:
            _kept = found
    return found[0][:n], found[1][:n]


@dataclass
class Words:
    """The words of ``len(first) - 1`` texts; text i has words first[i] up to first[i + 1]."""

    data: np.ndarray  # all bytes, one text after the other
    offsets: np.ndarray  # where each text begins
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text, and a 64-bit hash of each; ``lower`` maps A-Z to a-z first."""
    data, offsets = utf8(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(texts) + 1, np.int64), none.astype(np.uint64))
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    opens = np.zeros(n + 1, bool)  # a text begins here, or all end
    opens[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    up, down = powers(n + 1)
    total = np.cumsum(_BYTE[data] * up[:n])
    left = np.where(starts > 0, total[np.maximum(starts, 1) - 1], np.uint64(0))
    hashes = mix((total[ends - 1] - left) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k values; there are ``len(hashes) - k + 1``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))


def span_hash(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of n values from ``begin`` on; runs of one length compare like ``sequence_hash``."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[begin + n] - total[begin]) * down[begin] + n.astype(np.uint64))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice have about ``size`` bytes (``SLICE_BYTES`` by default)."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(sizes.astype(np.int64)) // (size or SLICE_BYTES)
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One list for each pair of neighbouring edges."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
