"""Models on a planted signal."""

import pytest
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.models.grid import expand_grid
from tabscore.models.rotation import member_covariances
from tabscore.sources.tables import FEATURES

SCALED = [f"{f}_m2" for f in FEATURES]


@pytest.fixture(scope="module")
def parts(rows):
    planted = rows.withColumn("target", F.expr("cast(f1 > 100 or f9 >= 3 as int)"))
    table = ts.materialize(ts.feature_set(planted, "train_only"))
    return ts.split_by_flag(table)


def area(model, df):
    return ts.auc(ts.score(model, df, "id", "p1", ["target"]), "target", "p1").first().auc


def scores(model, df):
    return {r.id: r.p1 for r in ts.score(model, df, "id").collect()}


@pytest.fixture(scope="module")
def trees(parts):
    return ts.gbt(parts[0], SCALED, 3, 0.2, 5)


def test_gbt_finds_the_signal_and_repeats(parts, trees):
    assert area(trees, parts[1]) > 0.95
    assert scores(ts.gbt(parts[0], SCALED, 3, 0.2, 5), parts[1]) == scores(trees, parts[1])
    assert all(0 <= p <= 1 for p in scores(trees, parts[1]).values())


def test_many_models_in_one_scan(parts, trees):
    other = ts.gbt(parts[0], SCALED, 1, 0.2, 2)
    svm = ts.clustered_svm(parts[0], SCALED, centers=2, max_iter=5)
    both = ts.score_many({"a": trees, "b": other, "c": svm}, parts[1], "id", ["target"])
    assert both.columns == ["id", "target", "a", "b", "c"]
    rows = both.collect()
    assert {r.id: r.a for r in rows} == scores(trees, parts[1])
    assert {r.id: r.b for r in rows} == scores(other, parts[1])
    assert {r.id: r.c for r in rows} == scores(svm, parts[1])
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_both_class_probabilities(parts, trees):
    r = ts.score(trees, parts[1], "id", "p1", p0="p0").first()
    assert r.p0 == pytest.approx(1 - r.p1)


def test_save_and_load(parts, trees, tmp_path):
    ts.save_model(trees, str(tmp_path / "m"))
    assert scores(ts.load_model(str(tmp_path / "m")), parts[1]) == scores(trees, parts[1])


def test_a_short_fit_is_a_prefix_of_a_longer_one(parts, trees):
    short = ts.gbt(parts[0], SCALED, 3, 0.2, 2)
    a = {r.id: r.score for r in ts.staged_scores(trees, parts[1], ["id"], [2]).collect()}
    b = {r.id: r.score for r in ts.staged_scores(short, parts[1], ["id"], [2]).collect()}
    assert a == b


def test_last_stage_is_the_model(parts, trees):
    staged = ts.staged_auc(trees, parts[1]).orderBy("round").collect()
    assert [r["round"] for r in staged] == [1, 2, 3, 4, 5]
    assert staged[-1].auc == pytest.approx(area(trees, parts[1]), abs=1e-12)


def test_watchlist_feeds_early_stopping(parts, trees):
    train, valid, _ = parts
    table = ts.watchlist(trees, {"train": train, "valid": valid})
    assert table.columns == ["model_id", "round", "split", "metric"]
    got = {(r["round"], r.split): r.metric for r in table.collect()}
    assert len(got) == 10
    staged = {r["round"]: r.auc for r in ts.staged_auc(trees, valid).collect()}
    assert all(got[k, "valid"] == pytest.approx(a, abs=1e-12) for k, a in staged.items())
    stop = ts.early_stop(table.filter("split = 'valid'"), 1, 0.5).first()
    assert stop.model_id == "model_1" and stop.stop_round == 2

    def mse(scores, y, s, by):
        return scores.groupBy(*by).agg(F.avg((F.col(s) - F.col(y)) ** 2).alias("mse"))

    custom = ts.watchlist(trees, {"valid": valid}, rounds=[1, 5], metric=mse, model_id="m").collect()
    assert {(r.model_id, r["round"]) for r in custom} == {("m", 1), ("m", 5)} and all(r.metric > 0 for r in custom)


def test_best_rounds_minimises_the_deviance(parts, trees):
    losses = ts.deviance_by_round(trees, parts[1])
    assert losses[ts.best_rounds(trees, parts[1]) - 1] == min(losses)


def test_first_fraction(parts):
    first, rest = ts.first_fraction(parts[2], "id", 0.75)
    n = parts[2].count()
    assert first.count() == int(0.75 * n) and first.count() + rest.count() == n
    assert first.agg(F.max("id")).first()[0] < rest.agg(F.min("id")).first()[0]


def test_first_fraction_of_few_rows(spark):
    few = spark.range(3)
    first, rest = ts.first_fraction(few, "id", 0.25)
    assert (first.count(), rest.count()) == (0, 3)
    with pytest.raises(ValueError, match="NULL"):
        ts.first_fraction(few.selectExpr("nullif(id, 1) as id"), "id", 0.5)


def test_early_stop_needs_both_classes_and_keeps_to_its_iterations(parts, monkeypatch):
    from tabscore.models import mlp as module

    train, valid, _ = parts
    with pytest.raises(ValueError, match="one class"):
        ts.mlp_early_stop(train, valid.filter("target = 1"), SCALED[:2], [2])
    asked = []
    fit = module.mlp
    monkeypatch.setattr(module, "mlp", lambda *a, **k: asked.append(a[3]) or fit(*a, **k))
    ts.mlp_early_stop(train, valid, SCALED[:2], [2], chunk=3, max_iter=7, rounds=0)
    assert asked == [3, 3, 1]


def test_importance(parts, trees):
    shares = {r.feature: r.share for r in ts.importance(trees).collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "f1_m2"
    drops = {r.feature: r.auc_drop for r in ts.permutation_importance(trees, parts[1], ["f1_m2", "f14_m2"]).collect()}
    assert drops["f1_m2"] > 0.1 > abs(drops["f14_m2"])


def test_grid_prefix_sharing_changes_nothing(parts):
    train, valid, _ = parts
    grid = ts.gbt_grid(train, valid, SCALED, rounds=[1, 3], depths=[2], etas=[0.1, 0.3]).collect()
    assert len(grid) == 4 and len({r.model_id for r in grid}) == 4
    for r in grid:
        alone = ts.gbt(train, SCALED, r.max_depth, r.learn_rate, r.ntrees)
        assert r.auc == pytest.approx(area(alone, valid), abs=1e-12)


def test_grid_search_and_leaderboard(parts):
    train, valid, everything = parts

    def make(df, depth, rounds):
        return ts.gbt(df, SCALED, depth, 0.2, rounds)

    results = ts.grid_search(make, {"depth": [1, 2], "rounds": [1, 2]}, train, valid)
    top = ts.leaderboard(results, "auc", 1).first()
    assert top.auc == max(r.auc for r in results.collect()) and not top.in_sample
    model = ts.refit(make, {"depth": top.depth, "rounds": top.rounds}, everything)
    assert area(model, valid) > 0.8
    custom = ts.grid_search(
        make,
        {"depth": [1], "rounds": [1]},
        train,
        valid,
        metric=lambda s, y, p: s.groupBy("model_id").agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("mse")),
    )
    assert 0 < custom.first().mse < 0.25


def test_expand_grid():
    grid = {"a": [1, 2, 3], "b": [4, 5]}
    assert len(expand_grid(grid)) == 6
    assert expand_grid(grid)[0] == {"a": 1, "b": 4}


def test_mlp(parts):
    train, valid, _ = parts
    model = ts.mlp(train, SCALED, [6], 30)
    assert area(model, valid) > 0.9
    best, history = ts.mlp_early_stop(train, valid, SCALED, [4], chunk=5, max_iter=25, rounds=1, tol=1e-3)
    assert area(best, valid) == pytest.approx(max(history), abs=1e-12)


def test_rotation_forest(parts, tmp_path):
    train, valid, _ = parts
    model = ts.rotation_forest(train, SCALED, members=3, depth=4)
    assert area(model, valid) > 0.85
    ts.save_model(model, str(tmp_path / "rf"))
    assert scores(ts.load_model(str(tmp_path / "rf")), valid) == scores(model, valid)


def test_member_covariances(parts):
    train = parts[0]
    [cov] = member_covariances(train, SCALED[:3], 1, "id", 1, 1.0)
    expected = train.select(SCALED[:3]).toPandas().cov().to_numpy()
    assert cov == pytest.approx(expected, abs=1e-9)


def test_clustered_svm_beats_one_linear_svm(spark):
    """Two clusters with opposite slopes: no single line separates the classes."""
    from pyspark.ml.classification import LinearSVC

    rows = []
    for i in range(400):
        side, x = (-1 if i % 2 else 1), ((i * 37) % 200 - 100) / 50
        rows.append((i, 10.0 * side, x, int(x * side > 0)))
    df = spark.createDataFrame(rows, "id int, a double, b double, target int")
    model = ts.clustered_svm(df, ["a", "b"], centers=2)
    hit = ts.score(model, df, "id", "p", ["target"]).agg(F.avg((F.col("p") == F.col("target")).cast("double"))).first()[0]
    vectors = ts.assemble(df, ["a", "b"])
    plain = LinearSVC(labelCol="target", regParam=0.01).fit(vectors).transform(vectors)
    flat = plain.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    assert hit > 0.95 > flat


def test_kernel_svm_learns_a_circle(spark):
    rows = [(i, ((i * 29) % 101) / 50 - 1, ((i * 53) % 97) / 48 - 1) for i in range(500)]
    df = spark.createDataFrame([(i, x, y, int(x * x + y * y < 0.5)) for i, x, y in rows], "id int, x double, y double, target int")
    for options in ({"kernel": "polynomial"}, {"kernel": "gaussian", "gamma": 1.0, "features": 64}):
        model = ts.kernel_svm_approx(df, ["x", "y"], k=2, reg=0.001, **options)
        right = ts.score(model, df, "id", "p", ["target"]).agg(F.avg((F.col("p") == F.col("target")).cast("double")))
        assert right.first()[0] > 0.9
    with pytest.raises(ValueError):
        ts.kernel_svm_approx(df, ["x", "y"], kernel="laplace")


def test_gated_experts(parts, tmp_path):
    train, valid, _ = parts
    model = ts.gated_experts(train, SCALED, m=3, hidden=4, rounds=2, max_iter=15)
    assert area(model, valid) > 0.9
    ts.save_model(model, str(tmp_path / "g"))
    assert scores(ts.load_model(str(tmp_path / "g")), valid) == scores(model, valid)


def test_stream_scores_like_a_table(spark, parts, trees, tmp_path):
    valid = parts[1].withColumnRenamed("id", "t_id")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    valid.repartition(3).write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(valid.schema).parquet(source)
        ts.score_stream(trees, stream, sink, str(tmp_path / "offsets")).awaitTermination()
    got = {r.t_id: r.probability for r in spark.read.parquet(sink).collect()}
    assert got == scores(trees, parts[1])
