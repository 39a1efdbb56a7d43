"""Best-fit packing with certified partitions.

Documents are cut to pieces of at most a sequence, and pieces are packed by
best-fit decreasing in partitions of bounded size. Dual feasible functions give a
lower bound of each partition's sequences. Where a partition has more than its
bound, the pieces of its unfilled sequences are exchanged with those of other
partitions and packed again; a partition at its bound gives its emptiest sequence
only, as the bounds of many partitions add up to more than the bound of all. This
goes on until ``MISSES`` rounds one after the other, each with the pieces dealt anew, save nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.near_text import runs
from tabscore.llm.tables import Scratch
from tabscore.llm.tokens import word_ids
from tabscore.llm.words import slices

CAPACITY = 4096
END = 1  # the id that ends a document
PART = 20_000  # pieces of a partition, about
MISSES = 2
# bits of a sequence's number: round, part, sequence of the part
ROUND_BITS, PART_BITS, SEQUENCE_BITS = 10, 31, 22

PACKED = "item long, part int, sequence int, offset long, loose boolean"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most sequences that dual feasible functions prove necessary for pieces of 1 to ``capacity`` tokens.

    Used are the identity, Fekete and Schepers' u(k) for k up to 20, and, for each
    e up to half a sequence, the one that rounds pieces over capacity - e up and drops
    those below e (Martello and Toth's bound L2).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(whole % capacity == 0, size * k, (whole // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    number, weight = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    above = number[-1] - number[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    return max(best, int((above + -(-middle // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and offset of each piece, and the room left in each sequence."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room
    rooms: list[int] = []
    mask = 0  # bit r: some sequence has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            s = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, s = capacity, len(rooms)
            rooms.append(capacity)
        sequence[i], offset[i] = s, capacity - room
        rooms[s] = room - n
        open_[room - n].append(s)
        mask |= 1 << (room - n)
    return sequence, offset, np.array(rooms, np.int64)


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part = table.column("part").to_numpy()
            item, length = table.column("item").to_numpy(), table.column("length").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                sequence, offset, rooms = best_fit(length[a:b], capacity)
                loose = rooms > 0
                if len(rooms) <= lower_bound(length[a:b], capacity):
                    loose &= np.arange(len(rooms)) == rooms.argmax()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(item[a:b]),
                        pa.array(part[a:b]),
                        pa.array(sequence.astype(np.int32)),
                        pa.array(offset),
                        pa.array(loose[sequence]),
                    ],
                    ["item", "part", "sequence", "offset", "loose"],
                )

    return run


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, misses: int = MISSES) -> DataFrame:
    """``item, round, part, sequence, offset`` of pieces ``item, length`` shorter than a sequence."""

    def deal(rows: DataFrame, n: int, turn: int) -> DataFrame:
        parts = max(1, -(-n // PART))
        dealt = rows.select("item", "length", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)).cast("int").alias("part"))
        packed = dealt.repartition("part").sortWithinPartitions("part", "item").mapInArrow(_pack(capacity), PACKED)
        return scratch.save(packed.withColumn("round", F.lit(turn)), f"packed-{turn}")

    # what a round settles stays in its table; only its loose pieces go on
    latest = deal(items, items.count(), 0)
    settled = [latest.filter("not loose")]
    turn = missed = 0
    while missed < misses:
        turn += 1
        loose = latest.filter("loose")
        state = loose.agg(F.count("*"), F.countDistinct("part", "sequence")).first()
        if state[1] < 2 or turn >= 1 << ROUND_BITS:
            break
        again = deal(loose.select("item").join(items, "item"), state[0], turn)
        if again.agg(F.countDistinct("part", "sequence")).first()[0] < state[1]:
            latest, missed = again, 0
            settled.append(latest.filter("not loose"))
        else:
            missed += 1
            scratch.drop(f"packed-{turn}")
    packed = reduce(DataFrame.union, [*settled, latest.filter("loose")])
    return packed.select("item", "round", "part", "sequence", "offset")


def _cut(capacity: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in slices(batches):
            ids, edges = words.encode(batch.column("text"))
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for row, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def sequence_number() -> Column:
    """One number for round, part and sequence; raises where one of them has more bits than it is given."""
    number = F.lit(0).cast("bigint")
    fits = F.lit(True)
    for name, bits in (("round", ROUND_BITS), ("part", PART_BITS), ("sequence", SEQUENCE_BITS)):
        number = F.shiftleft(number, bits) + F.col(name)
        fits = fits & (F.col(name) < (1 << bits))
    return F.when(fits, number).otherwise(F.raise_error(F.lit("too many rounds, parts or sequences to number")).cast("bigint"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, misses: int = MISSES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where each piece of each document goes.

    A document is its text's ids and an end; null and empty texts are the end
    alone. Longer ones are cut after every ``capacity`` ids; whole pieces fill a
    sequence each. Repeated rows are packed as often as they occur. Equal lengths go in
    the order of their rows. An empty table gives no rows; other columns are not read.
    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = docs.select("doc_id", "text").mapInArrow(
        _cut(capacity, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = scratch.save(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.filter(F.col("length") < capacity).select("item", "length"), scratch, capacity, misses)
    placed = packed.select("item", sequence_number().alias("sequence_id"), "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.filter(F.col("length") >= capacity)
    return (
        pieces.join(placed, "item")
        .select(*columns, "sequence_id", "offset")
        .union(whole.select(*columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    )
