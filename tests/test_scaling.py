import pytest
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.sources.tables import FEATURES


def test_scaled_columns_have_mean_0_and_sd_1(rows):
    scaled = ts.Scaler(tuple(FEATURES), {"m2": "not tournament and validation = 0"}).fit(rows).transform(rows)
    train = scaled.filter("not tournament and validation = 0")
    for f in FEATURES:
        mean, sd = train.agg(F.avg(f"{f}_m2"), F.stddev_samp(f"{f}_m2")).first()
        assert mean == pytest.approx(0, abs=1e-9) and sd == pytest.approx(1, abs=1e-9)


def test_statistics_of_one_table_apply_to_another(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    model = ts.Scaler(("x",), {"": "true"}).fit(train)
    assert model.transform(spark.createDataFrame([(1.0,)], "x double")).first().x == 0.0


def test_each_split_by_its_own_statistics(rows):
    table = ts.feature_table(rows, "train")
    assert len(table.columns) == 49
    stats = table.groupBy("validation").agg(F.avg("f4_mn"), F.stddev_samp("f4_mn_sq"), F.avg("f14_prod")).collect()
    for _, mean, sd, product in stats:
        assert mean == pytest.approx(0, abs=1e-9)
        assert sd == pytest.approx(1, abs=1e-9)
        assert product == pytest.approx(0, abs=1e-9)
    assert len(ts.feature_table(rows, "test").columns) == 47
    with pytest.raises(ValueError):
        ts.feature_table(rows, "live")


def test_constant_and_missing_values(spark):
    df = spark.createDataFrame([(1, 5, None, 0), (2, 5, 3, 0), (3, 5, 4, 0)], "x int, k int, g int, s int")
    out = ts.Scaler(("x", "k", "g"), {"": "true"}).fit(df).transform(df).orderBy("x").collect()
    assert [r.x for r in out] == [-1, 0, 1]
    assert [r.k for r in out] == [None] * 3
    assert [r.g for r in out] == [None] * 3  # one missing value makes the statistics unknown
    skip = ts.Scaler(("g",), {"": "true"}, na_policy="skip").fit(df).transform(df, keep=["x"]).orderBy("x").collect()
    assert skip[0].g is None and skip[2].g == pytest.approx(0.5**0.5)
    split = ts.SplitScaler(("x", "k"), {"a": "s = 0", "b": "s = 1"}, True, "k").fit(df).transform(df)
    assert all(r.k_mn is None and r.k_mn_sq is None for r in split.collect())


def test_row_outside_all_splits_is_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (5, 1), (9, 2)], "x int, s int")
    out = ts.SplitScaler(("x",), {"a": "s = 0", "b": "s = 1"}, False, None).fit(df).transform(df).collect()
    assert [r.x_mn is None for r in sorted(out, key=lambda r: r.s)] == [False] * 4 + [True]


def test_long_and_wide_scaling_agree(rows):
    train = rows.filter("not tournament")
    long = ts.zscore(ts.to_long(train, ["id"], FEATURES))
    wide = ts.Scaler(tuple(FEATURES), {"": "true"}).fit(train).transform(train, keep=["id"])
    both = ts.to_long(wide, ["id"], FEATURES, value="w").join(long, ["id", "variable"])
    assert both.filter("abs(w - z) > 1e-9 or w is null or z is null").count() == 0
    assert both.count() == train.count() * 14


def test_bit_width_is_fitted(spark):
    train = spark.createDataFrame([("c_24",), ("c_3",)], "c1 string")
    encoder = ts.BitEncoder("c1").fit(train)
    assert encoder.names() == ["c_1", "c_2", "c_3", "c_4", "c_5"]
    later = spark.createDataFrame([("c_40",), ("c_1",)], "c1 string")
    with pytest.raises(Exception, match="does not fit"):
        encoder.transform(later).collect()
    relaxed = ts.BitEncoder("c1", larger="null").fit(train).transform(later).collect()
    assert [tuple(r)[1:] for r in relaxed] == [(None,) * 5, (0, 0, 0, 0, 1)]


def test_feature_sets(rows):
    assert len(ts.feature_set(rows, "all").columns) == 8 + 56
    assert len(ts.feature_set(rows, "train_only").columns) == 8 + 14
    assert ts.cols_containing(ts.feature_set(rows, "all_training"), "_m1")
