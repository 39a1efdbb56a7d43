import pytest
from pyspark.sql import functions as F

import tabscore as ts
from conftest import SF
from tabscore.sources import scratch
from tabscore.sources.tables import TOURNAMENT_SCHEMA


def test_submission_problems(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "t_id long")
    good = spark.createDataFrame([(i, 0.5) for i in range(1, 7)], "t_id long, probability double")
    assert ts.validate_submission(good, ids).collect() == []
    bad = spark.createDataFrame(
        [(1, 0.5), (1, 0.5), (2, 1.5), (3, None), (4, float("nan")), (9, 0.1), (5, -0.1)], "t_id long, probability double"
    )
    assert sorted(map(tuple, ts.validate_submission(bad, ids).collect())) == [
        (1, "duplicate"),
        (2, "out_of_range"),
        (3, "no_probability"),
        (4, "no_probability"),
        (5, "out_of_range"),
        (6, "missing"),
        (9, "unknown"),
    ]


def test_only_the_latest_submission_counts(spark):
    log = spark.createDataFrame(
        [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.6), (3, 5, None), (4, 1, 0.7), (4, 1, 0.4)], "user int, ts int, auc double"
    ).withColumn("n", F.monotonically_increasing_id())
    log = log.withColumn("n", F.when(F.col("auc") == 0.4, 100).otherwise(1))
    out = ts.rank_latest(log, "user", "ts", "auc", top=3, tie="n").orderBy("rank").collect()
    assert [(r["rank"], r.user, r.auc) for r in out] == [(1, 2, 0.6), (2, 1, 0.5), (3, 4, 0.4)]


def test_public_and_private_parts(rows):
    scores = rows.filter("tournament").select(F.col("id").alias("t_id"), "target", (F.col("f14") / 97.0).alias("probability"))
    out = {r.part: r.auc for r in ts.public_private_auc(scores).collect()}
    assert set(out) == {"public", "private"}
    bits = F.conv(F.substring(F.md5(F.col("t_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    public = scores.filter(bits % 100 < 33)
    assert ts.auc(public, "target", "probability").first().auc == pytest.approx(out["public"])
    everything = {r.part for r in ts.public_private_auc(scores, share=100).collect()}
    assert everything == {"public"}


@pytest.mark.parametrize("first, step", [(9, 10), (0, 1), (10**16, 100)])
def test_a_third_of_the_ids_is_public_whatever_their_pattern(spark, first, step):
    ids = spark.range(6000).selectExpr(f"{first}L + id * {step} as t_id", "cast(id % 2 as int) target")
    every = ids.withColumn("probability", F.lit(0.5))
    part = F.conv(F.substring(F.md5(F.col("t_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100 < 33
    assert 0.30 < every.filter(part).count() / 6000 < 0.36
    assert {r.part for r in ts.public_private_auc(every).collect()} == {"public", "private"}


def test_a_folder_named_like_a_csv_is_read_as_what_its_files_are(spark, tmp_path):
    path = f"{tmp_path}/old.csv.d/features"
    spark.range(3).write.parquet(path)
    assert ts.read_table(spark, path).count() == 3


def test_csv_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "c_2"), (2, 4, "c_3")], "t_id long, f1 int, c1 string")
    for fmt in ("csv", "csv.gz"):
        path = str(tmp_path / f"t.{fmt}")
        ts.write_features(df, path, fmt)
        assert sorted(map(tuple, ts.read_table(spark, path, df.schema).collect())) == [(1, None, "c_2"), (2, 4, "c_3")]
    with pytest.raises(ValueError):
        ts.read_table(spark, str(tmp_path / "t.csv"))
    with pytest.raises(ValueError):
        ts.write_features(df, str(tmp_path / "x"), "xls")


def test_header_order_is_checked(spark, tmp_path):
    path = str(tmp_path / "wrong.csv")
    spark.createDataFrame([(1, 2)], "b int, a int").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        ts.read_table(spark, path, spark.createDataFrame([], "a int, b int").schema).collect()


def test_submission_files(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("t_id"), (F.col("id") / 10).alias("probability"))
    ts.write_submission(df, str(tmp_path / "s"), files=1)
    assert len(list((tmp_path / "s").glob("*.csv"))) == 1
    assert sorted(ts.read_submission(spark, str(tmp_path / "s")).collect()) == sorted(df.collect())


def test_contest_parts(rows):
    assert rows.count() == 1473
    assert ts.training(rows).count() + ts.tournament(rows).count() == 1473
    assert [(f.name, f.dataType) for f in ts.tournament(rows).schema] == [(f.name, f.dataType) for f in TOURNAMENT_SCHEMA]


def test_orders_without_lines_keep_their_row(spark):
    gaps = ts.order_features(spark, SF, "left")
    assert gaps.filter("f1 is null").count() == 27


def test_scratch_folder_is_the_checkpoint_folder_else_the_warehouse(spark, monkeypatch):
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    assert scratch.scratch_root(spark) == (scratch.checkpoint_root(spark) or warehouse)
    assert scratch.scratch_path(spark) != scratch.scratch_path(spark)
    monkeypatch.setattr(scratch, "checkpoint_root", lambda session: "/shared/checkpoints")
    assert scratch.scratch_path(spark, "x").startswith("/shared/checkpoints/tabscore-x-")


def test_materialize_keeps_the_rows_with_and_without_a_folder(spark, tmp_path, monkeypatch):
    df = spark.range(7).selectExpr("id", "id * id as sq")
    monkeypatch.setattr(scratch, "checkpoint_root", lambda session: None)
    kept = scratch.materialize(df)
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.is_cached
    scratch.release(kept)
    assert not kept.is_cached
    monkeypatch.setattr(scratch, "checkpoint_root", lambda session: str(tmp_path))
    written = scratch.materialize(df, "squares")
    assert sorted(written.collect()) == sorted(df.collect())
    assert [p.name.startswith("tabscore-squares-") for p in tmp_path.iterdir()] == [True]
    scratch.delete_path(spark, str(next(tmp_path.iterdir())))
    assert not list(tmp_path.iterdir())


def test_tune_respects_the_user(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        ts.tune(spark)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")
        ts.tune(spark)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


class _Elsewhere:
    """The session as it would be on a cluster."""

    def __init__(self, spark):
        self._spark, self.conf, self._jvm, self._jsc = spark, spark.conf, spark._jvm, spark._jsc
        self.sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()


def test_a_local_folder_is_no_scratch_folder_of_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(scratch, "checkpoint_root", lambda session: None)
    assert scratch.scratch_root(spark)
    with pytest.raises(RuntimeError, match="shared"):
        scratch.scratch_root(_Elsewhere(spark))


def test_scratch_is_released(spark):
    kept = scratch._made.copy()
    scratch._made.clear()
    path = scratch.scratch_path(spark, "once")
    scratch.write_table(spark.range(3), path)
    assert scratch.path_exists(spark, path)
    assert ts.release_scratch(spark) == 1 and not scratch.path_exists(spark, path)
    assert ts.release_scratch(spark) == 0
    scratch._made.update(kept)
