"""Language-model scoring by the likelihood of a subword lattice.

The pieces of an existing vocabulary are drawn one after the other, each by its
unigram probability, until the end of the document is drawn. A text's
probability is the sum over all ways to cut its words into pieces, by a
forward recursion in log space. The vocabulary is given; its scores are estimated from
the training documents. A word's probability depends on nothing else, so each
word of the corpus is scored once, and documents add up their words' values.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.tables import Scratch, crc
from tabscore.llm.words import mix, slices, words_of

BLOCK_BYTES = 16_000_000  # text of a block of documents that share a dictionary
ALPHA = 0.1  # added to each piece's count
WIDE = 64  # longer words are scored one by one
_SPACE = b" "
_UP = np.uint64(0x9E3779B97F4A7C55)


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file of lines ``base64 rank``, in the order of ranks."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(pieces: list[bytes]):
    import public_tokenizers
    import tiktoken

    ranks = {piece: i for i, piece in enumerate(pieces)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Lattice:
    """Pieces with log10 probabilities, to be looked up by hash for many words at once."""

    pieces: list[bytes]
    scores: np.ndarray

    def __post_init__(self) -> None:
        self.by_piece = dict(zip(self.pieces, self.scores.tolist(), strict=True))
        self.longest = max(map(len, self.pieces), default=0)
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.sorted_scores = hashes[order], self.scores[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        # a bucket of the sorted hashes by their first bits
        self.bucket = np.searchsorted(self.hashes, np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits))
        self.depth = int(np.diff(self.bucket).max(initial=0))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -np.inf)
        at = self.bucket[(h >> self.shift).astype(np.int64)]
        for step in range(self.depth):
            spot = np.minimum(at + step, len(self.hashes) - 1)
            hit = self.hashes[spot] == h
            out[hit] = self.sorted_scores[spot[hit]]
        return out

    def one(self, word: bytes) -> float:
        """log10 of a word's marginal probability, for any length."""
        text = _SPACE + word
        forward = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            terms = [
                forward[begin] + score
                for begin in range(max(0, end - self.longest), end)
                if (score := self.by_piece.get(text[begin:end])) is not None
            ]
            if terms:
                top = max(terms)
                if top > -np.inf:
                    forward[end] = top + np.log10(sum(10 ** (t - top) for t in terms))
        return forward[-1]

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's marginal probability."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        out = np.zeros(len(words))
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length > WIDE:
                out[rows] = [self.one(words[r]) for r in rows.tolist()]
                continue
            n = int(length)
            text = np.frombuffer(b"".join(_SPACE + words[r] for r in rows.tolist()), np.uint8).reshape(-1, n)
            value = _BYTES[text]
            forward = np.full((n + 1, len(rows)), -np.inf)
            forward[0] = 0.0
            hashes = np.zeros((n, len(rows)), np.uint64)  # of the piece from each byte up to the current end
            for end in range(1, n + 1):
                hashes[:end] = hashes[:end] * _UP + value[:, end - 1]
                begin = max(0, end - self.longest)
                spans = hashes[begin:end]
                sizes = np.arange(end - begin, 0, -1, dtype=np.uint64)[:, None]
                scores = self.lookup(mix(spans + sizes).reshape(-1)).reshape(spans.shape)
                terms = forward[begin:end] + scores
                top = terms.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0.0)
                total = np.power(10.0, terms - safe).sum(axis=0)
                forward[end] = np.where(np.isfinite(top), safe + np.log10(np.maximum(total, 1e-300)), -np.inf)
            out[rows] = forward[n]
        return out


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _hash(piece: bytes) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for b in piece:
        h = h * _UP + _BYTES[b]
    return mix(h + np.uint64(len(piece)))[0]


def _pack(codes: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int64)


BLOCK = (
    "block long, doc_ids array<long>, held_out array<boolean>, edges array<int>, codes binary, "
    "words array<binary>, train array<long>"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: each word is a number in the block's dictionary, which has frequent words first."""
    ids: list[int | None] = []
    held: list[bool] = []
    counts: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    spelled: dict[int, bytes] = {}
    size = number = 0
    task = TaskContext.get()
    part_id = task.partitionId() if task else 0  # the blocks are written before they are read

    def flush() -> pa.RecordBatch:
        nonlocal size, number
        every = np.concatenate(hashes)
        per_doc = np.concatenate(counts)
        codes, unique = pd.factorize(every)
        rank = np.argsort(-np.bincount(codes, minlength=len(unique)), kind="stable")
        place = np.empty(len(unique), np.int64)
        place[rank] = np.arange(len(unique))
        codes = place[codes]
        learns = np.repeat(~np.array(held, bool), per_doc)
        train = np.bincount(codes[learns], minlength=len(unique))
        words = [spelled[h] for h in unique[rank].tolist()]
        row = pa.RecordBatch.from_pylist(
            [
                {
                    "block": part_id << 32 | number,
                    "doc_ids": ids,
                    "held_out": held,
                    "edges": np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32).tolist(),
                    "codes": _pack(codes),
                }
            ],
            schema=pa.schema(
                [
                    ("block", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())),
                    ("held_out", pa.list_(pa.bool_())),
                    ("edges", pa.list_(pa.int32())),
                    ("codes", pa.binary()),
                ]
            ),
        )
        edge = pa.array([0, len(words)], pa.int32())
        lists = [
            pa.ListArray.from_arrays(edge, pa.array(words, pa.binary())),
            pa.ListArray.from_arrays(edge, pa.array(train.astype(np.int64))),
        ]
        out = pa.RecordBatch.from_arrays([*row.columns, *lists], [*row.schema.names, "words", "train"])
        for x in (ids, held, counts, hashes):
            x.clear()
        spelled.clear()
        size, number = 0, number + 1
        return out

    for part in slices(batches):
        words = words_of(part.column("text"), lower=True)
        unique, first = np.unique(words.hashes, return_index=True)
        raw = words.data.tobytes()
        begin, end = words.starts[first].tolist(), words.ends[first].tolist()
        for h, a, b in zip(unique.tolist(), begin, end, strict=True):
            if h not in spelled:
                spelled[h] = raw[a:b]
        ids += part.column("doc_id").to_pylist()
        held += part.column("held_out").to_pylist()
        counts.append(words.counts)
        hashes.append(words.hashes)
        size += len(words.data)
        if size >= BLOCK_BYTES:
            yield flush()
    if ids:
        yield flush()


def _piece_counts(pieces: list[bytes]):
    """How often the training words use each piece, as the vocabulary's own encoder cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pieces)
        total = np.zeros(len(pieces), np.float64)
        for batch in batches:
            times = batch.column("c").to_numpy().astype(np.float64)
            texts = [" " + w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            ids = encoder.encode_ordinary_batch(texts, num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            total += np.bincount(flat, np.repeat(times, [len(x) for x in ids]), minlength=len(pieces))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], ["piece", "n"])

    return run


def _word_scores(pieces: list[bytes], scores: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, scores)
        for batch in batches:
            for part in (batch.slice(i, 5000) for i in range(0, len(batch), 5000)):
                value = lattice.words(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), part.column("c"), pa.array(value.astype(np.float32))], ["word", "c", "lp"]
                )

    return run


@dataclass
class Totals:
    tokens: int  # training tokens, ends included
    distinct: int
    ends: int  # training documents


def _scores(totals: Totals, end_score: float):
    schema = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = totals.tokens + 1 * (totals.distinct + 1)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                codes = _unpack(row.column("codes")[0].as_py())
                edges = row.column("edges").flatten().to_numpy()
                place = row.column("place").flatten().to_numpy()
                c, lp = np.zeros(len(place), np.int64), np.zeros(len(place))
                c[place] = row.column("c").flatten().to_numpy()
                lp[place] = row.column("lp").flatten().to_numpy()

                def total(values: np.ndarray, codes=codes, edges=edges) -> np.ndarray:
                    run = np.concatenate([[0], np.cumsum(values[codes])])
                    return run[edges[1:]] - run[edges[:-1]]

                n = np.diff(edges).astype(np.int64)
                base = total(np.log10((c + 1) / floor)) + np.log10((totals.ends + 1) / floor)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("doc_ids").flatten(),
                        row.column("held_out").flatten(),
                        pa.array(n + 1),
                        pa.array(total((c > 0).astype(np.int64)) + (totals.ends > 0)),
                        pa.array(np.full(len(n), totals.tokens, np.int64)),
                        pa.array(base),
                        pa.array(total(lp) + end_score),
                    ],
                    schema,
                )

    return run


def score_documents(docs: DataFrame, path: str, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Words are lower-cased (A-Z) and split at ASCII white space; a null text is
    empty and has its end alone. Documents whose CRC-32 of doc_id as text is 2 modulo 7 are
    held out; the others train. ``score`` is log10 of the text's marginal probability,
    ``base_score`` that of a smoothed word model. A word's value travels as a
    32-bit float. A piece that no training word uses keeps ``alpha`` of a count. Every byte
    must be a piece, so every text has a cut. Repeated rows stay; an empty
    table gives no rows; other columns are not read. ``path`` names the
    vocabulary, which the driver reads.
    """
    scratch = Scratch(docs.sparkSession, "lattice")
    pieces = read_pieces(path)
    rows = docs.select("doc_id", (crc("doc_id") % 7 == 2).alias("held_out"), "text")
    blocks = scratch.save(rows.mapInArrow(_blocks, BLOCK), "blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "w"))
    words = entries.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.train").alias("c"))
    words = scratch.save(words, "words")
    sums = words.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = blocks.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    totals = Totals((sums["n"] or 0) + ends, sums["v"] + (ends > 0), ends)

    used = words.filter("c > 0").mapInArrow(_piece_counts(pieces), "piece long, n long")
    count = np.full(len(pieces), alpha)
    for r in used.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        count[r["piece"]] += r["n"]
    mass = count.sum() + ends + alpha
    scores = np.log10(count / mass)
    scored = scratch.save(words.mapInArrow(_word_scores(pieces, scores), "word binary, c long, lp float"), "scored")

    values = entries.select("block", "place", F.col("w.words").alias("word")).join(scored, "word")
    by_block = values.groupBy("block").agg(F.collect_list(F.struct("place", "c", "lp")).alias("d"))
    by_block = by_block.select("block", "d.place", "d.c", "d.lp")
    # a block without a word has no entry
    nothing = [F.coalesce(x, F.array().cast(f"array<{t}>")).alias(x) for x, t in (("place", "int"), ("c", "bigint"), ("lp", "float"))]
    whole = blocks.select("block", "doc_ids", "held_out", "edges", "codes").join(by_block, "block", "left")
    whole = whole.select("doc_ids", "held_out", "edges", "codes", *nothing)
    return whole.mapInArrow(
        _scores(totals, float(np.log10((ends + alpha) / mass))),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
