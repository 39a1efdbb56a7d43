import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabscore.llm import decontaminate
from tests.llm.fixtures import corpus, documents, prose


def split(text):
    return [w for w in (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def fixture():
    rng = random.Random(3)
    items = [(i, prose(rng, n, 300)) for i, n in enumerate([12, 20, 33, 33, 60, 5, 3, 1])]
    items += [(8, None), (9, ""), (10, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (2, items[2][1]), (11, "again again again again again again")]
    rows = [r for r in corpus() if r[1] is None or "\n" not in r[1]]
    rows = [r for r in rows if r[1] is None or not any(c in r[1] for c in "\t\x0b　\x1c")]
    for i, text in items:
        if text:
            near = text.split()
            near[len(near) // 2] = "other"
            rows.append((1000 + i, f"{prose(rng, 30)} {text.upper()} {prose(rng, 9)}", "en", "s", 1))
            rows.append((2000 + i, f"{prose(rng, 3)} {' '.join(near)}", "en", "s", 1))
            rows.append((3000 + i, " ".join(text.split()[1:]), "en", "s", 1))
    return items, rows


def brute(items, rows, threshold):
    """Best similarity of any window of each document to each item."""
    out = {}
    for item, text in items:
        own = split(text)
        if not own:
            continue
        k = min(5, len(own))
        want = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
        for r in rows:
            w = split(r[1])
            grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            n = len(own) - k + 1
            for start in range(len(grams)):
                if not want.keys() & set(grams[start : start + n]):
                    continue
                have = Counter(grams[start : start + n])
                both = sum((have & want).values())
                similarity = both / (sum(have.values()) + n - both)
                if similarity >= threshold:
                    out[r[0], item] = max(out.get((r[0], item), 0), similarity)
    return out


def test_leaks_are_those_of_all_windows(spark):
    items, rows = fixture()
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(spark, rows), benchmark).collect()}
    want = brute(items, rows, 0.8)
    assert got == pytest.approx(want)


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents(spark), none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(documents(spark, []), one).count() == 0


@pytest.mark.parametrize("bits, flips", [(0, 0), (7, 0), (8, 1), (15, 1), (16, 2), (23, 2)])
def test_the_blocks_hold_every_fingerprint_within_the_radius(spark, bits, flips):
    rng = random.Random(bits)
    rows = []
    for i in range(60):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), bits):
            y ^= 1 << bit
        rows.append((i, *[v - (1 << 64) if v >> 63 else v for v in (x, y)]))
    df = spark.createDataFrame(rows, "i int, x long, y long")
    a = df.select("i", F.inline(decontaminate.block_values("x", flips)))
    b = df.select("i", F.inline(decontaminate.block_values("y", 0)))
    assert a.join(b, ["i", "block", "value"]).select("i").distinct().count() == 60


def test_the_radius_follows_from_the_threshold():
    assert [decontaminate.radius_of(t) for t in (1.0, 0.95, 0.9, 0.8, 0.7)] == [0, 15, 18, 23, 27]


def test_similar_sets_are_within_the_radius(spark):
    """Lists of weighted similarity 0.8, some of them full of repeated shingles."""
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        n = rng.choice([18, 45, 90, 180])
        shared = 8 * n // 9  # of n each: 8 / 10 of the union
        base = [rng.randrange(1, 1 << 60) for _ in range(n)]
        other = base[:shared] + [rng.randrange(1, 1 << 60) for _ in range(n - shared)]
        if i % 3 == 0:
            base[:shared] = other[:shared] = [base[0]] * shared
        elif i % 3 == 1:
            base[shared:], other[shared:] = [base[-1]] * (n - shared), [other[-1]] * (n - shared)
        rng.shuffle(other)
        rows.append((i, base, other))
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    prints = [decontaminate.simhash(df.select("i", decontaminate.numbered(F.col(c)).alias("shingles")), ["i"]) for c in "xy"]
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    both = prints[0].toDF("i", "a").join(prints[1].toDF("i", "b"), "i").select(apart.alias("d")).collect()
    assert len(both) == 3000 and max(r.d for r in both) <= decontaminate.radius_of(0.8)
    assert max(r.d for r in both) > 15


def test_fingerprints_decide_what_is_compared(spark, monkeypatch):
    """Items under the fingerprints of other shingles meet nothing; a radius of 0 leaves the exact copies."""
    items, rows = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    simhash = decontaminate.simhash

    def other(df, by, hashes="shingles"):
        own = simhash(df, by, hashes)
        return own.withColumn("fingerprint", F.bitwise_not("fingerprint")) if "item_id" in by else own

    monkeypatch.setattr(decontaminate, "simhash", other)
    assert decontaminate.find_leaks(documents(spark, rows), benchmark).count() == 0
    monkeypatch.setattr(decontaminate, "simhash", simhash)
    monkeypatch.setattr(decontaminate, "radius_of", lambda threshold: 0)
    near = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(spark, rows), benchmark).collect()}
    want = brute(items, rows, 0.8)
    assert near == {k: 1.0 for k, v in want.items() if v == 1.0} and len(near) < len(want)


def test_no_python_worker(spark):
    items, rows = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.find_leaks(documents(spark, rows), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not any(kind in plan for kind in ("Python", "Arrow", "Pandas"))


def test_windows_whose_altered_part_repeats_one_shingle(spark):
    """At 0.8 by weight, but many bits apart: the run of one word counts often in each bit."""
    rng = random.Random(8)
    items = [(i, prose(rng, 200, 3000)) for i in range(16)]
    rows = []
    for i, text in items:
        near = text.split()[:-21] + ["again"] * 21
        rows.append((i, f"{prose(rng, 10, 3000)} {' '.join(near)} {prose(rng, 10, 3000)}", "en", "s", 1))
    want = brute(items, rows, 0.8)
    assert len(want) == 16
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(spark, rows), benchmark).collect()}
    assert got == pytest.approx(want)
