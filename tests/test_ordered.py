import random

import pytest
from pyspark.sql import functions as F

import tabscore as ts


@pytest.mark.parametrize("n", [1, 3, 8])
def test_row_id_is_contiguous(spark, partitions, n):
    partitions(n)
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 5) for v in values], "v int, g int")
    out = ts.add_row_id(df, [F.desc("g"), "v"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 501))
    assert [(r.g, r.v) for r in out] == sorted(((v % 5, v) for v in values), key=lambda t: (-t[0], t[1]))


@pytest.mark.parametrize("n", [1, 3, 8])
def test_prefix_sums_with_a_hot_group(spark, partitions, n):
    partitions(n)
    rng = random.Random(2)
    data = [(i, None if i % 50 == 0 else ("hot" if i % 3 else f"g{i % 11}"), rng.randrange(9)) for i in range(600)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i int, g string, x int")
    got = {r.i: r.x_cum for r in ts.prefix_sums(df, "i", ["x"], ["g"]).collect()}
    running, expected = {}, {}
    for i, g, x in sorted(data):
        running[g] = running.get(g, 0) + x
        expected[i] = running[g]
    assert got == expected


def test_prefix_sums_without_groups(spark, partitions):
    partitions(5)
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("x"))
    out = ts.prefix_sums(df, "id", ["x"]).orderBy("id").collect()
    total = 0.0
    for r in out:
        total += r.x
        assert r.x_cum == pytest.approx(total)


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, x int")
    assert ts.add_row_id(df, "id", "n").collect() == []
    assert ts.prefix_sums(df, "id", ["x"]).collect() == []
