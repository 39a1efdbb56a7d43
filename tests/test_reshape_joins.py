import pytest
from pyspark.sql import functions as F

import tabscore as ts

COLS = ["f1", "f2", "f10"]


@pytest.fixture
def wide(spark):
    return spark.createDataFrame([(1, 10, None, 3), (2, 20, 5, 6)], "id long, f1 int, f2 int, f10 int")


def test_round_trip(wide):
    long = ts.to_long(wide, ["id"], COLS)
    assert long.count() == 6  # the NULL keeps its row
    back = ts.to_wide(long, "id", COLS, "value")
    assert back.columns == ["id", *COLS]
    assert sorted(back.collect()) == sorted(wide.collect())


def test_duplicates_raise_unless_allowed(spark, wide):
    long = ts.to_long(wide, ["id"], COLS)
    twice = long.unionByName(long.filter("id = 1 and variable = 'f1'"))
    with pytest.raises(Exception, match="duplicate rows"):
        ts.to_wide(twice, "id", COLS, "value").collect()
    assert ts.to_wide(twice, "id", COLS, "value", strict=False).count() == 2


def test_missing_combination_is_null(spark):
    long = spark.createDataFrame([(1, "f1", 7)], "id long, variable string, value int")
    assert ts.to_wide(long, "id", ["f1", "f2"], "value").first() == (1, 7, None)


def test_order_and_suffix(wide):
    assert ts.order_and_suffix(wide, "id", ["f10", "f1"], "_m1").columns == ["id", "f10_m1", "f1_m1"]


def test_unions(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert set(ts.union_fill(a, b).collect()) == {(1, 2), (3, None)}
    assert ts.union_same(a, a.select("y", "x")).collect() == [(1, 2), (1, 2)]
    with pytest.raises(ValueError):
        ts.union_same(a, b)


def test_bind_by_key_raises_on_unmatched_ids(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "t_id long, a double")
    b = spark.createDataFrame([(1, 0.3), (2, 0.4)], "t_id long, b double")
    assert sorted(ts.bind_by_key([a, b], "t_id").collect()) == [(1, 0.1, 0.3), (2, 0.2, 0.4)]
    for odd in (b.filter("t_id = 1"), b.unionByName(spark.createDataFrame([(9, 0.0)], b.schema))):
        with pytest.raises(Exception, match="without a partner"):
            ts.bind_by_key([a, odd], "t_id").collect()


def test_bind_by_order(spark):
    a = spark.createDataFrame([(30,), (10,), (20,)], "k long")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (3, "z")], "place int, v string")
    out = ts.bind_by_order(a, "k", b, "place").select("row_id", "k", "v").collect()
    assert sorted(out) == [(1, 10, "x"), (2, 20, "y"), (3, 30, "z")]
    with pytest.raises(Exception, match="without a partner"):
        ts.bind_by_order(a, "k", b.filter("place < 3"), "place").collect()


def test_bind_by_key_checks_whatever_is_read(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "t_id long, a double")
    b = spark.createDataFrame([(1, 0.3), (9, 0.4)], "t_id long, b double")
    with pytest.raises(Exception, match="without a partner"):
        ts.bind_by_key([a, b], "t_id").select("a", "b").collect()
    with pytest.raises(Exception, match="without a partner"):
        ts.bind_by_key([a, b], "t_id").count()
    twice = spark.createDataFrame([(1, 0.3), (2, 0.4), (2, 0.5)], "t_id long, b double")
    with pytest.raises(Exception, match="is repeated"):
        ts.bind_by_key([a, twice], "t_id").select("b").collect()
    null = spark.createDataFrame([(None, 0.3)], "t_id long, b double")
    with pytest.raises(Exception, match="without a partner"):
        ts.bind_by_key([null.withColumnRenamed("b", "a"), null], "t_id").collect()


def test_building_lookups_starts_no_job(spark):
    long = spark.range(200).select("id", (F.col("id") % 7).cast("string").alias("variable"), F.col("id").alias("value"))
    spark.sparkContext.setJobGroup("building", "no job yet")
    try:
        ts.lookup_stats(long, ts.variable_stats(long))
        ts.zscore(long)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_join_anchor_is_one_pass_over_the_keys(spark):
    wide = spark.createDataFrame([(1, 2, 3), (2, 5, None), (None, 1, 1)], "id long, f1 int, f5 int")
    long = ts.to_long(wide, ["id"], ["f1", "f5"]).union(spark.createDataFrame([(7, "f1", 4)], "id long, variable string, value int"))
    out = ts.join_anchor(long, "f5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.id, r.value, r.anchor_value) for r in out.collect()) == [(1, 2, 3), (2, 5, None)]


def test_join_anchor(spark):
    wide = spark.createDataFrame([(1, 2, 3), (2, 5, 7)], "id long, f1 int, f5 int")
    out = ts.join_anchor(ts.to_long(wide, ["id"], ["f1", "f5"]), "f5").collect()
    assert sorted((r.id, r.variable, r.value, r.anchor_value) for r in out) == [(1, "f1", 2, 3), (2, "f1", 5, 7)]
