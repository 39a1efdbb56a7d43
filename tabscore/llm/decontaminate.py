"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that is as long as a benchmark item and begins with a
shingle of one gets a 64-bit SimHash. (A window of the best similarity always begins
so: moved on to its first shared shingle, it loses none.) A fingerprint is cut into
``BLOCKS`` blocks, and an item is stored under every value that differs from its own
in a few bits of one block: two fingerprints within the radius agree that far in some
block, so the join of windows and items by block and value holds all pairs within the
radius. Of those the exact similarity of the weighted shingles decides.

The radius follows from the threshold. A shingle that occurs again counts as another
one (the shingle and the number of its occurrence), so weighted similarity is that of
sets, and sets of similarity s or more have a cosine of 2 s / (1 + s) or more:
each bit differs with a probability of at most acos(2 s / (1 + s)) / pi. The radius
takes ``DEVIATIONS`` of 64 such bits: 23 at 0.8, beyond which one of 100,000
windows of just that similarity lies (of 0.85 one of 1.7 million). All on the main path are DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.tables import Scratch, small, texts_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 8
BITS = 64
DEVIATIONS = 4.6

WINDOW = "array<struct<start:int,k:int,n_words:int>>"


def word_list(text: str = "text") -> Column:
    """Lower-cased words; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+"), "")


def shingles(words: Column, k: int) -> Column:
    """The hash of each run of k words. The outer transform computes the words once, not for each run."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (k - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), 0)


def simhash(rows: DataFrame, by: list[str], hashes: str = "shingles") -> DataFrame:
    """``by`` and ``fingerprint``: the sign of each bit over all shingles, each counted as often as it occurs."""
    each = rows.select(*by, F.explode(hashes).alias("h"))
    signs = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(BITS)]
    sums = each.groupBy(*by).agg(*signs)
    bits = [F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0)) for i in range(BITS)]
    return sums.select(*by, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def radius_of(threshold: float) -> int:
    """Within how many bits the fingerprints of sets of that similarity are."""
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return min(BITS, math.ceil(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p))))


def block_values(fingerprint: str, flips: int) -> Column:
    """An array of ``block, value``, with all values that differ in up to ``flips`` bits of a block.

    Fingerprints within BLOCKS * (flips + 1) - 1 bits have a block that differs in no more than ``flips``.
    """
    width = BITS // BLOCKS
    masks = [sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(width), n)]
    out = []
    for b in range(BLOCKS):
        value = F.shiftrightunsigned(fingerprint, b * width).bitwiseAND(F.lit((1 << width) - 1))
        out += [F.struct(F.lit(b).alias("block"), value.bitwiseXOR(F.lit(m)).alias("value")) for m in masks]
    return F.array(*out)


def numbered(hashes: Column) -> Column:
    """A list of shingles as a set: the first occurrence of each is itself, a later one a hash with its number."""
    ordered = F.array_sort(hashes)

    def one(x: Column, i: Column) -> Column:
        again = i + 1 - F.array_position(ordered, x)
        return F.when(again > 0, F.xxhash64(x, again)).otherwise(x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.transform(ordered, one))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists; a shingle's weight is the number of its occurrences."""
    both = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        both,
        F.lit(0),
        lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    shared = F.when(plain, F.size(both)).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, item_id, start, n_words, similarity, distance``: the best window of each leaked item.

    Words are split at ASCII white space and lower-cased. An item of fewer words
    than a shingle is one shingle; a null or empty item or document matches
    nothing. A window at the end of a document may be shorter than the item.
    Repeated rows are one; of equal windows the first counts. Null ids are values
    like others. Empty tables give no rows; other columns are not read.

    A window is lost only where its fingerprint lies beyond the radius: see the module.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = benchmark.select("item_id", word_list().alias("words")).filter(F.size("words") > 0).distinct()
    items = scratch.save(items.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE))), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE numbers

    def of_size(words: Column, k: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return reduce(lambda rest, s: F.when(k == s, shingles(words, s)).otherwise(rest), sizes, empty)

    items = items.select("item_id", "k", F.size("words").alias("n_words"), of_size(F.col("words"), F.col("k")).alias("shingles"))
    items = scratch.save(items, "item-shingles")
    begins = scratch.save(items.select("k", "n_words", F.explode("shingles").alias("h")).distinct(), "begins")

    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    none = text.select("doc_id", "text_hash", F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("h"))
    spread = [
        text.select("doc_id", "text_hash", F.lit(k).alias("k"), F.posexplode(shingles(word_list(), k)).alias("at", "h"))
        for k in sizes
    ]
    every = reduce(DataFrame.union, spread) if spread else none.limit(0)
    window = F.struct((F.col("at") + 1).alias("start"), "k", "n_words")
    touched = every.join(small(begins), ["k", "h"]).groupBy("doc_id", "text_hash").agg(F.collect_set(window).alias("windows"))
    touched = scratch.save(touched, "touched")

    same = text.doc_id.eqNullSafe(touched.doc_id) & (text.text_hash == touched.text_hash)
    found = text.join(texts_of(touched), same).select(text.doc_id, text.text_hash, "windows", *[
        shingles(word_list(), k).alias(f"s{k}") for k in sizes
    ])
    found = scratch.save(found.dropDuplicates(["doc_id", "text_hash"]), "found")

    def part(w: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        own = reduce(
            lambda rest, s: F.when(w["k"] == s, F.slice(F.col(f"s{s}"), w["start"], w["n_words"] - w["k"] + 1)).otherwise(rest),
            sizes,
            empty,
        )
        return F.struct(w["start"].alias("start"), w["k"].alias("k"), w["n_words"].alias("n_words"), own.alias("shingles"))

    windows = found.select("doc_id", "text_hash", F.inline(F.transform("windows", part)))
    long_enough = F.size("shingles") >= threshold * (F.col("n_words") - F.col("k") + 1)
    windows = windows.filter(long_enough).withColumn("content", F.xxhash64("shingles"))
    windows = scratch.save(windows, "windows")
    by = ["content", "k", "n_words"]
    contents = scratch.save(windows.groupBy(*by).agg(F.first("shingles").alias("shingles")), "contents")
    radius = radius_of(threshold)
    flips = radius // BLOCKS
    sets = contents.select(*by, numbered(F.col("shingles")).alias("shingles"))
    prints = scratch.save(simhash(sets, by), "fingerprints")
    known = ["item_id", "k", "n_words"]
    sets = items.withColumn("copy", F.xxhash64("shingles")).withColumn("shingles", numbered(F.col("shingles")))
    wanted = simhash(sets, [*known, "copy"]).withColumnRenamed("fingerprint", "wanted")
    probes = scratch.save(wanted.select(*known, "wanted", F.inline(block_values("wanted", flips))), "probes")
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("wanted")))
    met = prints.select(*by, "fingerprint", F.inline(block_values("fingerprint", 0)))
    met = met.join(small(probes), ["k", "n_words", "block", "value"]).select(*by, "item_id", near.alias("distance"))
    met = scratch.save(met.filter(F.col("distance") <= radius).distinct(), "met")

    exact = met.join(contents, by).join(
        items.select(F.col("item_id").alias("item"), F.col("k").alias("ik"), F.col("n_words").alias("in"), F.col("shingles").alias("own")),
        F.col("item_id").eqNullSafe(F.col("item")) & (F.col("k") == F.col("ik")) & (F.col("n_words") == F.col("in")),
    )
    exact = exact.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("own")))
    exact = exact.filter(F.col("similarity") >= threshold).select(*by, "item_id", "distance", "similarity")
    exact = scratch.save(exact.distinct(), "exact")
    best = F.struct("similarity", (-F.col("start")).alias("before"), "n_words", "distance")
    return (
        windows.drop("shingles")
        .join(exact, by)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(best).alias("best"))
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            (-F.col("best.before") - 1).alias("start"),
            F.col("best.n_words").alias("n_words"),
            F.col("best.similarity").alias("similarity"),
            F.col("best.distance").alias("distance"),
        )
    )
