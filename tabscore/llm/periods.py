"""Periodic runs of words by online dyadic square catching.

Words are appended to a text; for every power of two L the text falls into
blocks of L words. A completed block opens a catcher, which waits for its block to
come again p words later, for p from L up to 2 L - 1: it is compared with each
suffix of L words that ends with an appended word in that stretch, so every
appended word advances one comparison for each L. A hit says that words of period p
begin with the block. It is extended to both sides, and where it holds the period
twice it is a square. Squares of one stretch merge; a stretch that reaches the
text's end stays open and grows with the next words, and a closed one that holds
its period often enough is a run.

Nothing is lost: a run of period p >= L with four periods or more holds a whole block
of L words whose next copy, p words on, is in the run too.

Comparisons use hashes of word sequences: equal sequences have equal hashes, so no
hit is missed. Every run is compared word by word before it is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.words import Words, mix, powers, slices, words_of

LEAST = 6  # words of a run
TIMES = 4  # periods of a run

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, runs_sha256 string, collapsed string"

_INT = np.int64


class SquareCatchers:
    """Runs of one text, found while its words are appended.

    ``append`` takes any number of words (64-bit hashes); ``close`` ends the text
    and returns ``start, stop, period`` of its runs, ordered by start, then period.
    """

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 4:
            raise ValueError("a catcher finds stretches of four periods or more")
        self.least, self.times = least, times
        self.words = np.zeros(0, np.uint64)
        self.total = np.zeros(1, np.uint64)  # of the first words, times powers of the base
        self.runs: dict[tuple[int, int], int] = {}  # (start, stop) and the smallest period
        self.open = np.zeros((0, 2), _INT)  # start and period of stretches that reach the end

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Take more words; ``longest`` bounds the length of any run, if it is known."""
        if not len(words):
            return
        before, n = len(self.words), len(self.words) + len(words)
        self.up, self.down = powers(n + 1)
        self.words = np.concatenate([self.words, words])
        added = np.cumsum(words * self.up[before:n])
        self.total = np.concatenate([self.total, self.total[-1] + added])
        grown = self.open
        self.open = np.zeros((0, 2), _INT)
        if len(grown):
            self._settle(grown[:, 0], self._forward(np.full(len(grown), before) - grown[:, 1], grown[:, 1]), grown[:, 1])
        size = 1
        while self.times * size <= min(n, longest or n):
            self._advance(size, before, n)
            size *= 2

    def close(self) -> np.ndarray:
        n = len(self.words)
        for start, period in self.open.tolist():
            self._report(start, n, period)
        self.open = np.zeros((0, 2), _INT)
        found = sorted((start, period, stop) for (start, stop), period in self.runs.items())
        return np.array([(a, b, p) for a, p, b in found], _INT).reshape(-1, 3)

    def _advance(self, size: int, before: int, n: int) -> None:
        """Compare the suffixes of ``size`` words that the new words complete with the blocks that wait for them."""
        first, last = max(before - size + 1, size), n - size + 1
        if first >= last:
            return
        head = first - first % size
        seen = (self.total[first + size : last + size] - self.total[first:last]) * self.down[first:last]
        blocks = np.arange(head - size, last - size, size)  # the catchers' blocks
        awaited = (self.total[blocks + size] - self.total[blocks]) * self.down[blocks]
        hit = np.flatnonzero(seen == np.repeat(awaited, size)[first - head : last - head]) + first
        if not len(hit):
            return
        block = hit - hit % size - size
        period = hit - block
        inside = self._covered(block, hit + size)
        block, period = block[~inside], period[~inside]
        # of hits of one period in neighbouring blocks the first stands for all
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        new = np.ones(len(block), bool)
        new[1:] = (np.diff(period) != 0) | (np.diff(block) != size)
        block, period = block[new], period[new]
        stop = self._forward(block + size, period)
        start = self._backward(block, period)
        self._settle(start, stop, period)

    def _covered(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether words from begin to stop lie in one stretch of a smaller period, so a hit in them is a multiple of it."""
        n = len(self.words)
        known = np.array([*self.runs, *((s, n) for s, p in self.open.tolist() if n - s >= 2 * p)], _INT).reshape(-1, 2)
        if not len(known):
            return np.zeros(len(begin), bool)
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.maximum.accumulate(known[:, 1])
        at = np.searchsorted(known[:, 0], begin, "right")
        return (at > 0) & (reach[np.maximum(at, 1) - 1] >= stop)

    def _equal(self, at: np.ndarray, period: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``at`` come again ``period`` words later, by hash."""
        one = self.total[at + size] - self.total[at]
        two = self.total[at + period + size] - self.total[at + period]
        return one * self.up[period] == two

    def _forward(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the stretch of each period ends that goes on at ``at + period``."""
        room = len(self.words) - at - period
        return at + period + self._longest(room, lambda k: self._equal(at, period, k))

    def _backward(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the stretch of each period begins that goes back from ``at``."""
        return at - self._longest(at, lambda k: self._equal(at - k, period, k))

    @staticmethod
    def _longest(room: np.ndarray, holds) -> np.ndarray:
        """The largest k of at most ``room`` for which the first k comparisons hold, for all at once."""
        low = np.zeros(len(room), _INT)
        if not len(room):
            return low
        step = 1 << int(max(int(room.max()), 1)).bit_length() - 1
        while step:
            k = np.minimum(low + step, room)
            low = np.where((k > low) & holds(k), k, low)
            step //= 2
        return low

    def _settle(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        """Keep stretches that reach the end open, and report the closed ones."""
        n = len(self.words)
        square = stop - start >= 2 * period
        ends = stop == n
        keep = np.stack([start, period], 1)[ends]
        self.open = np.unique(np.concatenate([self.open, keep]), axis=0)
        for a, b, p in np.stack([start, stop, period], 1)[square & ~ends].tolist():
            self._report(a, b, p)

    def _report(self, start: int, stop: int, period: int) -> None:
        """Store a stretch if it is a run, after comparing its words; hashes alone may have drawn it too long."""
        least = max(self.least, self.times * period)
        if stop - start < least:
            return
        same = self.words[start : stop - period] == self.words[start + period : stop]
        if same.all():
            parts = [(start, stop)]
        else:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            parts = [(start + a, start + b + period) for a, b in edges.reshape(-1, 2).tolist()]
        for a, b in parts:
            if b - a >= least:
                self.runs[a, b] = min(period, self.runs.get((a, b), period))


def runs_of(words: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """``start, stop, period`` of the runs of each text (words of the text from 0), and the text of each.

    All texts are appended to one text, each behind a mark that occurs once:
    no stretch goes across a mark.
    """
    counts = words.counts
    n, texts = len(words.hashes), len(counts)
    place = np.arange(n) + np.repeat(np.arange(texts), counts) + 1
    marked = np.empty(n + texts, np.uint64)
    marked[place] = words.hashes
    marks = words.first[:-1] + np.arange(texts)
    taken = mix(np.arange(texts, dtype=np.uint64) + np.uint64(0x51ED270B))
    marked[marks] = taken
    catchers = SquareCatchers(least, times)
    catchers.append(marked, int(counts.max()) if texts else 0)
    found = catchers.close()
    text = np.searchsorted(marks, found[:, 0], "right") - 1
    found[:, :2] -= marks[text, None] + 1
    return found, text


def _joined(words: Words, keep: np.ndarray, text: int) -> bytes:
    """The kept words of a text, joined by single spaces."""
    a, b = words.first[text], words.first[text + 1]
    mine = np.flatnonzero(keep[a:b]) + a
    if not len(mine):
        return b""
    starts, sizes = words.starts[mine], words.ends[mine] - words.starts[mine]
    ends = np.cumsum(sizes + 1)
    out = np.full(ends[-1] - 1, 32, np.uint8)
    gap = np.repeat(starts - (ends - sizes - 1), sizes)
    spots = np.ones(ends[-1], bool)
    spots[ends - 1] = False
    spots = np.flatnonzero(spots)
    out[spots] = words.data[spots + gap]
    return out.tobytes()


def _scan(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text")
            words = words_of(texts)
            found, of = runs_of(words, least, times)
            edge = np.zeros(len(words.hashes) + 1, _INT)
            np.add.at(edge, words.first[of] + found[:, 0] + found[:, 2], 1)
            np.add.at(edge, words.first[of] + found[:, 1], -1)
            keep = np.cumsum(edge[:-1]) == 0
            bounds = np.searchsorted(of, np.arange(len(part) + 1))
            lengths = found[:, 1] - found[:, 0]
            digests, collapsed = [], []
            for i in range(len(part)):
                a, b = bounds[i], bounds[i + 1]
                rows = zip(found[a:b, 0].tolist(), lengths[a:b].tolist(), found[a:b, 2].tolist(), strict=True)
                digests.append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in rows).encode()).hexdigest())
                collapsed.append(_joined(words, keep, i).decode())
            runs = pa.StructArray.from_arrays(
                [pa.array(x) for x in (found[:, 0], lengths, found[:, 2])], ["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(words.counts.astype(_INT)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs),
                    pa.array(digests),
                    pa.array(collapsed, pa.large_string()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "runs_sha256", "collapsed"],
            )

    return run


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """``doc_id, n_words, runs, runs_sha256, collapsed`` of every row.

    ``runs`` holds ``start, length, period`` (in words, by start, then period) of every
    stretch of consecutive words of smallest period q and max(least, times * q) words or
    more that no neighbouring word extends; ``runs_sha256`` is the digest of their lines.
    ``collapsed`` has the words, joined by one space, without those that a run
    contains after its first period. Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.

    A null or empty text has no words, no runs and an empty rest. Rows are
    judged one by one: repeated and null keys are rows like others; an empty table
    gives no rows, and other columns are not read. Nothing is shuffled; a task holds
    about a megabyte of texts (or one longer text).
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan(least, times), RESULT)


def longest_run():
    """The run of greatest length; ties go to the smallest start, then period. Null without a run."""
    first = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    )
    return F.get(first, F.lit(0))
