"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles. Each tree splits the documents by the value
of a chosen minwise token, then the parts by another one, until a node is small;
its documents are then compared exhaustively by their sketches. Independent
trees repeat this for recall; every pair found is confirmed on the full sets.
(Christiani and Pagh, "Set similarity search beyond MinHash", 2017; Christiani,
Pagh and Sivertsen, "Scalable and robust set similarity join", 2018.)
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.tables import Scratch, components, small, texts_of
from tabscore.llm.words import mix, sequence_hash, slices, words_of

TOKENS = 128  # minwise tokens of a document
SHALLOW = 3  # documents whose nodes are still large at this depth get more trees
DEPTH = 6
MISS = 1e-4  # a pair at the threshold is missed so often at most, for nodes that close at SHALLOW or at DEPTH
NODE = 48  # a node of so many documents at most is compared exhaustively
BLOCK = 500  # sets of a block of a node that stays larger, about; its blocks are compared in pairs
BLOCK_SHINGLES = 500_000  # and the shingles of a block, about
# A sketch estimates the similarity with a deviation of 0.032 near 0.85; pairs 4.5 deviations below are not confirmed.
SLACK = 0.145

_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def miss_rate(similarity: float, depth: int, trees: int) -> float:
    """How often no tree puts a pair of sets into one node at a depth.

    Trees draw from the same ``TOKENS`` tokens, so they are independent only for a
    given number of equal tokens, which is binomial.
    """
    equal = np.arange(TOKENS + 1)
    ways = np.array([math.comb(TOKENS, m) for m in equal], float)
    chance = ways * similarity**equal * (1 - similarity) ** (TOKENS - equal)
    return float(chance @ (1 - (equal / TOKENS) ** depth) ** trees)


def trees_for(similarity: float, depth: int) -> int:
    """The number of trees that keeps ``miss_rate`` within ``MISS``."""
    trees = 1
    while miss_rate(similarity, depth, trees) > MISS:
        trees += 1
    return trees


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words, all of them as one."""
    words = words_of(batch.column("text"), lower=True)
    whole = sequence_hash(words.hashes, k)
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = int(b - a)
        if n >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        else:
            sets.append(sequence_hash(words.hashes[a:b], n) if n else np.zeros(0, np.uint64))
    return sets


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """``TOKENS`` minwise tokens (32 bits each) of each set; none may be empty."""
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), TOKENS), np.uint32)
    for i, seed in enumerate(_SEEDS):
        y = (every ^ np.uint32(seed & np.uint64(0xFFFFFFFF))) * np.uint32((seed >> np.uint64(32)) | np.uint64(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        out[:, i] = np.minimum.reduceat(y, begins)
    return out


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            tokens: list[bytes | None] = [None] * len(sets)
            keys: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, minwise([sets[i] for i in full]), strict=True):
                    tokens[i] = row.tobytes()
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(tokens, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "key", "tokens"],
            )

    return run


def _paths(trees: range):
    """For each document and tree, its node at each depth; a node's path picks the next token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            rows = np.arange(len(tokens))
            for tree in trees:
                path = np.full(len(tokens), mix(np.array([tree + 1], np.uint64))[0])
                nodes = []
                for _ in range(DEPTH):
                    chosen = (path % np.uint64(TOKENS)).astype(np.int64)
                    path = mix(path ^ mix(tokens[rows, chosen].astype(np.uint64) + (chosen.astype(np.uint64) << np.uint64(32))))
                    nodes.append(pa.array(path.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), *nodes], ["key", *[f"p{d}" for d in range(1, DEPTH + 1)]]
                )

    return run


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: the low byte of each token."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a column; only the last group of a batch waits."""
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = table.column(by).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()


def find(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked nodes, in place, until every link is inside one."""
    while len(i):
        root[:] = find(root)
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _compare(least: float):
    """Pairs of documents of one node whose estimated similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "node"):
            nodes = table.column("node").to_numpy()
            keys = table.column("key").combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            sketch = _sketch_matrix(table.column("sketch"))
            edges = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]]))
            left, right, waiting = [], [], 0
            for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                i, j = np.triu_indices(b - a, 1)
                left.append(i + a)
                right.append(j + a)
                waiting += len(i)
                if waiting > 200_000 or n == len(edges) - 2:
                    x, y = np.concatenate(left), np.concatenate(right)
                    near = _similar(sketch[x], sketch[y]) >= least if len(x) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(x[near])), keys.take(pa.array(y[near]))], ["a", "b"]
                    )
                    left, right, waiting = [], [], 0

    return run


def _nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sketch, best = _sketch_matrix(batch.column("sketch")), np.full(len(batch), -1.0)
        pivots = [batch.column("pivots").field(i) for i in range(batch.column("pivots").type.num_fields)]
        at = np.zeros(len(batch), int)
        for i, p in enumerate(pivots):
            near = _similar(sketch, _sketch_matrix(p.field("sketch")))
            other = np.array([x != y for x, y in zip(p.field("key").to_pylist(), batch.column("key").to_pylist(), strict=True)])
            near = np.where(other, near, -1.0)
            at, best = np.where(near > best, i, at), np.maximum(near, best)
        names = [p.field("key").to_pylist() for p in pivots]
        pivot = pa.array([names[i][r] for r, i in enumerate(at)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("key"), pivot, pa.array(best)], ["node", "key", "pivot", "near"]
        )


def _grow(scratch: Scratch, reps: DataFrame, trees: range, name: str) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """``node, key`` of the small nodes of each depth; the keys in large nodes at ``SHALLOW``; ``node, key`` of those at ``DEPTH``."""
    schema = "key binary, " + ", ".join(f"p{d} long" for d in range(1, DEPTH + 1))
    open_ = scratch.save(reps.select("key", "tokens").mapInArrow(_paths(trees), schema), f"{name}-0")
    leaves, deep = [], None
    for depth in range(1, DEPTH + 1):
        node = f"p{depth}"
        sizes = open_.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1")
        kept = scratch.save(open_.drop(*[f"p{d}" for d in range(1, depth)]).join(sizes, node), f"{name}-{depth}")
        if depth == 1:
            scratch.drop(f"{name}-0")
        leaves.append(kept.filter(f"n <= {NODE}").select(F.col(node).alias("node"), "key"))
        open_ = kept.filter(f"n > {NODE}").drop("n")
        if open_.isEmpty():
            return leaves, deep, None
        if depth == SHALLOW:
            deep = open_.select("key").distinct()
    return leaves, deep, open_.select(F.col(node).alias("node"), "key")


def candidates(scratch: Scratch, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a, b`` of different sets that meet in a small node of some tree with similar sketches,
    and ``node, key, size`` of the nodes that are large at every depth, if there are any.

    The documents of such a node share all tokens chosen so far. Each is paired with the
    nearest of four pivots here, which brings most copies of one text together;
    ``crowd_links`` compares what is still apart.

    The first trees are as many as ``SHALLOW`` asks for. A pair that they put into one node there either
    meets in it, or both its documents are in a node that goes on branching: those
    get the other trees that ``DEPTH`` asks for.
    """
    least = threshold - SLACK
    reps = sets.filter("key is not null").groupBy("key").agg(F.first("tokens").alias("tokens"), F.first("n_shingles").alias("size"))
    reps = scratch.save(reps, "reps")
    first, last = trees_for(threshold, min(SHALLOW, DEPTH)), trees_for(threshold, DEPTH)
    leaves, deep, crowded = _grow(scratch, reps, range(first), "paths")
    if deep is not None and first < last:
        deep = reps.join(scratch.save(deep, "deep"), "key", "left_semi")
        more, _, more_crowded = _grow(scratch, deep, range(first, last), "more-paths")
        leaves += more
        if more_crowded is not None:
            crowded = more_crowded if crowded is None else crowded.union(more_crowded)
    sketch = F.concat(*[F.substring("tokens", 4 * i + 1, 1) for i in range(TOKENS)]).alias("sketch")
    sketches = scratch.save(reps.select("key", "size", sketch), "sketches")
    pairs, dense = [], None
    if crowded is not None:
        dense = crowded.join(sketches, "key")
        pivots = dense.groupBy("node").agg(
            F.struct(
                *[
                    F.min(F.struct(F.xxhash64("key", "node", F.lit(s)).alias("h"), "key", "sketch")).alias(f"v{s}")
                    for s in range(4)
                ]
            ).alias("pivots"),
        )
        pivots = scratch.save(pivots, "pivots")
        met = dense.join(small(pivots, 2_000), "node").mapInArrow(
            _nearest_pivot, "node long, key binary, pivot binary, near double"
        )
        pairs.append(met.filter(F.col("near") >= least).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        dense = scratch.save(dense.select("node", "key", "size"), "dense")
    rows = reduce(DataFrame.union, leaves).join(sketches.drop("size"), "key")
    pairs.append(
        rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(least), "a binary, b binary")
    )
    every = reduce(DataFrame.union, pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return scratch.save(every.filter("a <> b").distinct(), "pairs"), dense


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of ``left`` shares with each of ``right``, exactly."""
    sets = [*left, *right]
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    again = times > 1  # a shingle of one set is shared by none
    ids, owner = (np.cumsum(again) - 1)[ids[again[ids]]], owner[again[ids]]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    both, step = np.zeros((len(left), len(right))), max(1, 4_000_000 // len(sets))
    for begin in range(0, int(again.sum()), step):
        some = slice(*np.searchsorted(ids, [begin, begin + step]))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[some], ids[some] - begin] = 1
        both += has[: len(left)] @ has[len(left) :].T
    return both


def _block_links(percent: int):
    """Each linked set of a pair of blocks with its root in the forest of links there.

    ``side`` is -1 for the sets of the first block, 1 for those of the second, 0 for a block with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "pair"):
            pair, side = table.column("pair").to_numpy(), table.column("side").to_numpy()
            keys, members = table.column("key"), table.column("members")
            edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                left, right = np.flatnonzero(side[a:b] <= 0), np.flatnonzero(side[a:b] >= 0)
                if not len(left) or not len(right):
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in members.slice(a, b - a).to_pylist()]
                n = np.array([len(x) for x in sets])
                both = shared([sets[i] for i in left], [sets[j] for j in right])
                i, j = np.nonzero(100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
                root = np.arange(b - a)
                union(root, left[i], right[j])
                root = find(root)
                hit = np.flatnonzero(root != np.arange(b - a))
                own = pa.array(keys.slice(a, b - a).to_pylist(), pa.binary())
                yield pa.RecordBatch.from_arrays([own.take(pa.array(hit)), own.take(pa.array(root[hit]))], ["a", "b"])

    return run


def crowd_links(scratch: Scratch, dense: DataFrame, roots: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """``a, b``: links that join what confirmed links left apart in large nodes; None where nothing is apart.

    Sets of a node's largest component are not compared with each other. All others are
    compared with each other and with the largest component, block by block on the full sets.
    """
    named = dense.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    named = scratch.save(named.withColumn("root", F.coalesce("root", "key")), "crowds")
    groups = named.groupBy("node", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    nodes = groups.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("top")
    )

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")

    nodes = nodes.filter("n > top.n").select(
        "node",
        F.col("top.root").alias("top"),
        blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others"),
        blocks(F.col("top.n"), F.col("top.size")).alias("tops"),
    )
    nodes = scratch.save(nodes, "apart-nodes")
    if nodes.isEmpty():
        return None
    in_top = F.col("root") == F.col("top")
    rows = named.join(small(nodes), "node").withColumn("in_top", in_top)
    at = F.pmod(F.xxhash64("key", F.lit(5)), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("at", at)

    def up_to(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    def pair(kind: int, i, j, side):
        return F.struct(F.xxhash64("node", F.lit(kind), i, j).alias("pair"), side.cast("int").alias("side"))

    own = F.col("at")
    with_others = F.transform(up_to("others"), lambda j: pair(0, F.least(own, j), F.greatest(own, j), F.signum(own - j)))
    with_tops = F.transform(up_to("tops"), lambda j: pair(1, own, j, F.lit(-1)))
    as_top = F.transform(up_to("others"), lambda i: pair(1, i, own, F.lit(1)))
    pairs = F.when(F.col("in_top"), as_top).otherwise(F.concat(with_others, with_tops))
    met = rows.select("key", F.inline(pairs)).join(members, "key").repartition("pair").sortWithinPartitions("pair")
    return scratch.save(met.mapInArrow(_block_links(percent), "a binary, b binary"), "crowd-links")


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(part, k)]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, representative`` for every row of ``docs``.

    Rows are linked where 100 * intersection >= percent * union of their sets of
    shingles (A-Z lower-cased); component_id is the smallest doc_id reachable by
    links. Equal sets are one node, so copies cost one row each. A text that is
    null or has no word has an empty set and is its own component. Null doc_ids
    are never the smallest unless a component has no other; repeated rows stay.
    An empty table gives no rows; other columns are not read. Of the rows of a
    component, those with the smallest doc_id, then text_hash, are its representative
    (more than one only where both repeat); a row with an empty set represents itself.

    Recall: a pair of which a share m of the ``TOKENS`` tokens is equal shares a tree's node
    at depth d with probability m**d. The number of trees follows from the threshold so
    that a pair at it is missed with probability 0.0001 at most (``miss_rate``) where
    nodes close at depth 3, and with 0.0002 at most where they close deeper.
    """
    scratch = Scratch(docs.sparkSession, "near-text")
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sets = scratch.save(
        text.mapInArrow(
            _sets(shingle), "doc_id long, text_hash long, n_shingles long, key binary, tokens binary"
        ),
        "sets",
    )
    found, dense = candidates(scratch, sets, percent / 100)
    rows = sets.select("doc_id", "text_hash", "n_shingles", "key")
    wanted = found.select(F.col("a").alias("key")).union(found.select(F.col("b").alias("key")))
    if dense is not None:
        wanted = wanted.union(dense.select("key"))
    one = rows.join(wanted.distinct(), "key").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    one = scratch.save(one.select("r.doc_id", "r.text_hash").distinct(), "wanted")
    match = text.doc_id.eqNullSafe(one.doc_id) & (text.text_hash == one.text_hash)
    members = text.join(texts_of(one), match, "left_semi").mapInArrow(_full_sets(shingle), "key binary, members binary")
    members = scratch.save(members.dropDuplicates(["key"]), "members")

    def confirm(pairs: DataFrame) -> DataFrame:
        x = members.select(F.col("key").alias("a"), F.col("members").alias("x"))
        y = members.select(F.col("key").alias("b"), F.col("members").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_confirm(percent), "a binary, b binary")

    # One pair for each document first; then only pairs that would join two components.
    first = scratch.save(confirm(found.groupBy("b").agg(F.min("a").alias("a"))), "first")
    roots = scratch.save(components(scratch, first, "first-links"), "first-roots")
    sides = found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    sides = sides.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = sides.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = scratch.save(confirm(apart), "more")
    links = first.union(more)
    roots = components(scratch, links, "links")
    if dense is not None:
        roots = scratch.save(roots, "roots")
        crowd = crowd_links(scratch, dense, roots, members, percent)
        if crowd is not None:
            roots = components(scratch, links.union(crowd), "all-links")

    rooted = rows.join(roots, rows.key == roots.node, "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("root", "key").alias("root")
    )
    rooted = scratch.save(rooted, "rooted")
    scratch.drop("sets", "members", "sketches", "reps")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r")
    least = rooted.filter("root is not null").groupBy("root").agg(first_row)
    alone = F.col("root").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("text_hash") == F.col("r.text_hash"))
    return rooted.join(least, "root", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("r.doc_id")).alias("component_id"),
        (alone | same).alias("representative"),
    )
