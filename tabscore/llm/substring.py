"""Substring dedup by partitioned suffix trees.

A suffix is the text from one word on, cut where its piece ends (``window`` words or
more). Suffixes are split into groups that fit a task's memory, and each group's
subtree is built: its suffixes in order, and the depth of the node where each leaves
its neighbour. Internal nodes at depth ``window`` and more are the repeats; the deepest one above
a suffix is the longest run of its words that another suffix of the group has,
and the runs of a document join to maximal repeats.

Suffixes that can't repeat are left out early. Of the seeds (runs of ``seed``
words) of a suffix, the one with the smallest hash picks the suffix's group, so equal
suffixes are in one group, and neighbouring suffixes mostly too: they travel as
one piece of text. (By their own first words, neighbours would go to different groups
and every word would travel ``window`` times.) Of equal pieces of one text, one travels. A piece whose seed occurs
once in the corpus is a leaf. A group with more pieces than ``GROUP`` is split by longer seeds, at last by whole suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.near_text import runs
from tabscore.llm.tables import Scratch, texts_of
from tabscore.llm.words import SLICE_BYTES, Words, mix, sequence_hash, signed, slices, span_hash, words_of

WINDOW = 35
SEED = 14
GROUP = 4096  # pieces of a group that one subtree is built of

OWN = "array<struct<begin:int,stop:int>>"
PIECE = "struct<start:int,n:int,key:bigint>"
ROW = "key long, doc_id long, text_hash long, start int, n int, piece binary"
SPAN = "doc_id long, text_hash long, begin int, stop int"


@dataclass
class Pieces:
    """Runs of suffixes with one seed: seed hash, first suffix (a word), number of suffixes, text."""

    keys: np.ndarray
    starts: np.ndarray
    n: np.ndarray
    text: np.ndarray


def pieces_of(words: Words, seed: int, window: int) -> Pieces:
    """Group the suffixes of each text by the smallest (then first) seed of their first ``window`` words."""
    total = len(words.hashes) - window + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return Pieces(none.astype(np.uint64), none, none, none)
    low = sequence_hash(words.hashes, seed)
    at = np.arange(len(low))
    value, width, length = low, window - seed + 1, 1
    while length < width:
        shift = min(length, width - length)
        take = value[shift:] < value[:-shift]
        value, at = np.where(take, value[shift:], value[:-shift]), np.where(take, at[shift:], at[:-shift])
        length += shift
    text = np.repeat(np.arange(len(words.counts)), words.counts)[:total]
    whole = np.arange(total) + window <= words.first[text + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    seen = np.concatenate([[0], np.cumsum(whole)])
    n = np.diff(np.concatenate([seen[begin], seen[-1:]]))
    return Pieces(low[at[begin]], begin, n, text[begin])


def once_each(words: Words, found: Pieces, window: int) -> tuple[Pieces, np.ndarray]:
    """One piece of each different content of a text, and the words (flags) that equal pieces of one text cover.

    A text that says the same over and over has a piece at every word; these
    repeat whatever other texts hold, and one of them stands for all.
    """
    length = found.n + window - 1
    content = span_hash(words.hashes, found.starts, length)
    _, first, which, times = np.unique(
        mix(content ^ mix(found.text.astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True
    )
    again = times[which] > 1
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, found.starts[again], 1)
    np.add.at(edge, (found.starts + length)[again], -1)
    keep = np.sort(first)
    return Pieces(found.keys[keep], found.starts[keep], found.n[keep], found.text[keep]), np.cumsum(edge[:-1]) > 0


def _flag_spans(words: Words, flags: np.ndarray) -> pa.Array:
    """For each text, the runs of flagged words as ``begin, stop``."""
    head = np.zeros(len(flags) + 1, bool)
    head[words.first] = True
    before = np.concatenate([[False], flags[:-1]]) if len(flags) else flags
    begin = np.flatnonzero(flags & (~before | head[:-1]))
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    stop = np.flatnonzero(flags & (~after | head[1:])) + 1
    text = np.searchsorted(words.first, begin, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((x - words.first[text]).astype(np.int32)) for x in (begin, stop)], ["begin", "stop"]
    )
    edges = np.searchsorted(text, np.arange(len(words.counts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), spans)


def _scan(seed: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"))
            found, own = once_each(words, pieces_of(words, seed, window), window)
            digests = []
            for text in part.column("text").to_pylist():
                digests.append(hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest())
            rows = pa.StructArray.from_arrays(
                [
                    pa.array((found.starts - words.first[found.text]).astype(np.int32)),
                    pa.array(found.n.astype(np.int32)),
                    pa.array(signed(found.keys)),
                ],
                ["start", "n", "key"],
            )
            edges = np.searchsorted(found.text, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    part.column("text_hash"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(digests),
                    pa.ListArray.from_arrays(pa.array(edges), rows),
                    _flag_spans(words, own),
                ],
                ["doc_id", "text_hash", "n_words", "whole_sha256", "pieces", "own"],
            )

    return run


def _pieces_text(window: int):
    """The words of each shared piece, as rows of ``ROW``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, ids, hashes, starts, counts, texts = [], [], [], [], [], []
            columns = [part.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "pieces")]
            for doc_id, text_hash, text, found in zip(*columns, strict=True):
                words = text.encode().split()
                for x in found:
                    keys.append(x["key"])
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    starts.append(x["start"])
                    counts.append(x["n"])
                    texts.append(b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1]))
            yield _rows(keys, ids, hashes, starts, counts, texts)

    return run


def _rows(keys, ids, hashes, starts, counts, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array(hashes, pa.int64()),
            pa.array(starts, pa.int32()),
            pa.array(counts, pa.int32()),
            pa.array(texts, pa.binary()),
        ],
        ["key", "doc_id", "text_hash", "start", "n", "piece"],
    )


def ranks(words: Words, length: int) -> list[np.ndarray]:
    """Order-preserving numbers of the 1, 2, 4, ... words from each word on, up to ``length`` words or more.

    Texts end for themselves: what is cut by an end is smaller than what goes on there. (Karp, Miller and Rosenberg.)
    """
    total = len(words.hashes)
    left = np.repeat(words.first[1:], words.counts) - np.arange(total)  # words up to the text's end
    out, size = [np.unique(words.hashes, return_inverse=True)[1].astype(np.int64) + 1], 1
    while size < length:
        after = np.zeros(total, np.int64)
        after[: total - size] = out[-1][size:] if size < total else 0
        after[left <= size] = 0
        out.append(np.unique((out[-1] << 32) | after, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    return out


def subtree(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the suffixes of ``window`` words or more: the suffixes (as words) in order, and between
    neighbours the depth of the node where they part."""
    total = len(words.hashes)
    left = np.repeat(words.first[1:], words.counts) - np.arange(total)
    at = np.flatnonzero(left >= window)
    if not len(at):
        return at, np.zeros(0, np.int64)
    levels = ranks(words, int(words.counts.max()))
    order = at[np.argsort(levels[-1][at], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    room = np.minimum(left[a], left[b])
    depth = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        x, y = np.minimum(a + depth, total - 1), np.minimum(b + depth, total - 1)
        same = (depth + size <= room) & (levels[k][x] == levels[k][y])
        depth[same] += size
    return order, depth


def deepest(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (as words, rising) that lie below an internal node at depth ``window`` or more, and the depth of the deepest."""
    order, depth = subtree(words, window)
    above = np.zeros(len(order), np.int64)
    if len(order) > 1:
        above[:-1] = depth
        above[1:] = np.maximum(above[1:], depth)
    found = np.flatnonzero(above >= window)
    found = found[np.argsort(order[found], kind="stable")]
    return order[found], above[found]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups with about ``SLICE_BYTES`` of pieces (or one larger group), from batches sorted by key."""
    for table in runs(batches, "key"):
        keys = table.column("key").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = pa.compute.binary_length(table.column("piece")).to_numpy().astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])[heads] // SLICE_BYTES
        edges = [0, *heads[1:][np.diff(before) > 0].tolist(), len(table)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)


def _subtrees(window: int):
    """Spans of words that repeats of one group cover, as rows of ``SPAN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in portions(batches):
            column = table.column("piece").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            words = words_of(column.cast(pa.string()))
            at, depth = deepest(words, window)
            if not len(at):
                continue
            text = np.searchsorted(words.first, at, "right") - 1
            # runs that touch or overlap join: each begins behind the farthest end before it
            reach = np.maximum.accumulate(at + depth)  # a text's runs end in it, so no run reaches over a text's end
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] > reach[:-1]) | (text[1:] != text[:-1])
            begin, end = at[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            row = text[new]
            start = table.column("start").to_numpy()[row] - words.first[row]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().take(pa.array(row)),
                    table.column("text_hash").combine_chunks().take(pa.array(row)),
                    pa.array((begin + start).astype(np.int32)),
                    pa.array((end + start).astype(np.int32)),
                ],
                ["doc_id", "text_hash", "begin", "stop"],
            )

    return run


def _split(seed: int, window: int):
    """Pieces divided by longer seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "piece"):
            words = words_of(part.column("piece").cast(pa.string()))
            found = pieces_of(words, seed, window)
            texts = part.column("piece").to_pylist()
            cut, last = [], -1
            for row, begin, n in zip(found.text.tolist(), found.starts.tolist(), found.n.tolist(), strict=True):
                if row != last:
                    own, last = texts[row].split(), row
                begin -= int(words.first[row])
                cut.append(b" ".join(own[begin : begin + n + window - 1]))
            rows = pa.array(found.text)
            start = part.column("start").to_numpy()[found.text] + found.starts - words.first[found.text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(found.keys)),
                    part.column("doc_id").take(rows),
                    part.column("text_hash").take(rows),
                    pa.array(start.astype(np.int32)),
                    pa.array(found.n.astype(np.int32)),
                    pa.array(cut, pa.binary()),
                ],
                ["key", "doc_id", "text_hash", "start", "n", "piece"],
            )

    return run


def _crowded(scratch: Scratch, rows: DataFrame, window: int) -> list[DataFrame]:
    """Spans from groups of more than ``GROUP`` pieces.

    A piece with an equal one repeats as a whole. One of each equal ones goes on,
    to groups by longer seeds; the longest seed is the whole suffix.
    """
    same = F.md5("piece")
    out, level = [], 0
    for seed in sorted({min(24, window), min(30, window), window}):
        level += 1
        rows = scratch.save(rows.withColumn("same", same), f"crowded-{level}")
        equal = rows.groupBy("key", "same").agg(F.count("*").alias("copies"))
        twice = rows.drop("piece").join(equal.filter("copies > 1").drop("copies"), ["key", "same"])
        out.append(
            scratch.save(
                twice.select(
                    "doc_id", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("n") + window - 1).alias("stop")
                ),
                f"equal-{level}",
            )
        )
        one = rows.groupBy("key", "same").agg(F.first(F.struct(*ROW_COLUMNS[1:])).alias("r")).select("key", "r.*")
        split = scratch.save(one.mapInArrow(_split(seed, window), ROW), f"split-{level}")
        sizes = split.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        kept = split.join(sizes, "key")
        fits = kept.filter(F.col("members") <= GROUP) if seed < window else kept
        if seed == window:  # equal keys are equal suffixes
            done = fits.select("doc_id", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("n") + window - 1).alias("stop"))
        else:
            done = _grow(fits.select(*ROW_COLUMNS), window)
        out.append(scratch.save(done, f"spans-{level}"))
        rows = kept.filter(F.col("members") > GROUP).select(*ROW_COLUMNS)
        if seed == window or rows.isEmpty():
            break
    return out


ROW_COLUMNS = ["key", "doc_id", "text_hash", "start", "n", "piece"]


def _grow(rows: DataFrame, window: int) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), SPAN)


@dataclass
class Repeats:
    """``scanned``: a row for each document; ``marked``: those with repeats, their texts and spans of words."""

    scanned: DataFrame  # doc_id, text_hash, n_words, whole_sha256
    marked: DataFrame  # doc_id, text_hash, text, spans (array of begin, stop)


def find_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> Repeats:
    """Find every run of ``window`` words that also starts elsewhere, in this document or another.

    Words are unchanged; a null text has none, a text shorter than the window no
    suffix. Rows of the same doc_id and text are copies of each other and keep
    their rows; a null doc_id is a value like others. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scanned = scratch.save(
        text.mapInArrow(
            _scan(min(seed, window), window),
            f"doc_id long, text_hash long, n_words long, whole_sha256 string, pieces array<{PIECE}>, own {OWN}",
        ),
        "scanned",
    )
    pieces = scanned.select("doc_id", "text_hash", F.inline("pieces"))
    sizes = pieces.groupBy("key").agg(F.count("*").cast("int").alias("members")).filter("members > 1")
    row = F.struct("start", "n", "key", "members")
    found = pieces.join(sizes, "key").select("doc_id", "text_hash", row.alias("piece"))
    alone = scanned.filter(F.size("own") > 0).select("doc_id", "text_hash", F.lit(None).alias("piece"))
    of_text = F.collect_set("piece").alias("pieces")  # leaves out null
    shared = scratch.save(found.union(alone).groupBy("doc_id", "text_hash").agg(of_text), "shared")
    same = text.doc_id.eqNullSafe(shared.doc_id) & (text.text_hash == shared.text_hash)
    texts = scratch.save(
        text.join(texts_of(shared), same).select(text.doc_id, text.text_hash, "text", "pieces"), "texts"
    )

    def pieces_where(condition) -> DataFrame:
        chosen = F.filter("pieces", condition)
        rows = texts.select("doc_id", "text_hash", "text", chosen.alias("pieces")).filter(F.size("pieces") > 0)
        return rows.mapInArrow(_pieces_text(window), ROW)

    spans = scratch.save(_grow(pieces_where(lambda p: p["members"] <= GROUP), window), "spans")
    crowded = shared.filter(F.exists("pieces", lambda p: p["members"] > GROUP))
    if not crowded.isEmpty():
        for more in _crowded(scratch, pieces_where(lambda p: p["members"] > GROUP), window):
            spans = spans.union(more)
    spans = spans.union(scanned.select("doc_id", "text_hash", F.inline("own")))
    by_text = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    one = texts.select("doc_id", "text_hash", "text")
    match = one.doc_id.eqNullSafe(by_text.doc_id) & (one.text_hash == by_text.text_hash)
    marked = one.join(texts_of(by_text), match).select(one.doc_id, one.text_hash, "text", "spans")
    return Repeats(scanned.drop("pieces", "own"), marked)


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["begin"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        removed, kept = [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            gone = covered(len(words), spans)
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("text_hash"),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "text_hash", "n_removed", "kept"],
        )


def cut_repeats(found: Repeats) -> DataFrame:
    """``doc_id, text_hash, n_removed, kept`` of the marked documents: the words left, joined by one space."""
    return found.marked.mapInArrow(_cut, "doc_id long, text_hash long, n_removed long, kept string")
