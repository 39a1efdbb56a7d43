"""Feature jobs."""

from __future__ import annotations

import tabscore as ts
from tabscore.catalog.prepare import _BITS, _STATS, rows, train, z_sql
from tabscore.catalog.registry import query, r6, rounded, s6
from tabscore.plans.features import THREE_SPLITS
from tabscore.sources.tables import FEATURES

_WHERE = {
    "m1": "not tournament",
    "m2": "not tournament and validation = 0",
    "m3": "not tournament and validation = 1",
    "m4": "true",
}


def _four(suffixes: list[str], keys: str, table: str) -> str:
    """Scaled features of ``table`` by the statistics of the named populations."""
    ctes = ", ".join(f"{m} as (select {_STATS} from contest where {_WHERE[m]})" for m in suffixes)
    cols = ", ".join(z_sql(f, f"_{m}", m) for m in suffixes for f in FEATURES)
    return f"with {ctes} select {keys}, {cols} from {table}, {', '.join(suffixes)}"


def _round_features(df, keys):
    names = [c for c in df.columns if c not in keys and not c.startswith("c_")]
    return rounded(df, *names)


@query(
    "scale_train",
    f"with s as (select {_STATS} from training) select id, {', '.join(z_sql(f) for f in FEATURES)} from training, s",
)
def scale_train(spark, sf_dir):
    table = ts.materialize(train(spark, sf_dir).select("id", *FEATURES))
    return rounded(ts.Scaler(tuple(FEATURES), {"": "true"}).fit(table).transform(table), *FEATURES)


@query("scale_four", _four(["m1", "m2", "m3", "m4"], f"id, validation, target, {_BITS}", "training"))
def scale_four(spark, sf_dir):
    out = ts.scaled_features(ts.materialize(rows(spark, sf_dir)))
    return _round_features(out, ["id", "validation", "target"])


@query("scale_apply_test", _four(["m1", "m2", "m3", "m4"], f"t_id, {_BITS}", "tourn"))
def scale_apply_test(spark, sf_dir):
    return _round_features(ts.scaled_tournament(ts.materialize(rows(spark, sf_dir))), ["t_id"])


@query("feature_set_all", _four(["m1", "m2", "m3", "m4"], f"id, validation, target, {_BITS}", "training"))
def feature_set_all(spark, sf_dir):
    return _round_features(ts.feature_set(ts.materialize(rows(spark, sf_dir)), "all"), ["id", "validation", "target"])


@query("feature_set_train_only", _four(["m2"], f"id, validation, target, {_BITS}", "training"))
def feature_set_train_only(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    return _round_features(ts.feature_set(table, "train_only"), ["id", "validation", "target"])


@query("feature_set_all_training", _four(["m1"], f"id, validation, target, {_BITS}", "training"))
def feature_set_all_training(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    return _round_features(ts.feature_set(table, "all_training"), ["id", "validation", "target"])


# Own-split scaling: every row by the statistics of its split
_SPLIT = "case when tournament then 'tournament' when validation = 1 then 'valid' else 'train' end"
_KINDS = {
    "mn": {f: f"cast({f} as double)" for f in FEATURES},
    "mn_sq": {f: f"(cast({f} as double) * {f})" for f in FEATURES},
    "prod": {f: f"(cast({f} as double) * f5)" for f in FEATURES if f != "f5"},
}


def _own_split(kinds: list[str], keys: str, where: str) -> str:
    terms = [(k, f, x) for k in kinds for f, x in _KINDS[k].items()]
    stats = ", ".join(f"avg({x}) as m_{k}_{f}, stddev_samp({x}) as sd_{k}_{f}" for k, f, x in terms)
    cols = ", ".join(f"{s6(f'({x} - m_{k}_{f}) / nullif(sd_{k}_{f}, 0)')} as {f}_{k}" for k, f, x in terms)
    return f"""with t as (select *, {_SPLIT} as split from contest),
    s as (select split, {stats} from t group by split)
    select {keys}, {cols} from t join s using (split) where {where}"""


def _split_scaled(spark, sf_dir, squares, anchor, names):
    table = ts.materialize(rows(spark, sf_dir).select("id", "validation", "tournament", *FEATURES))
    scaler = ts.SplitScaler(tuple(FEATURES), THREE_SPLITS, squares, anchor)
    out = scaler.fit(table).transform(table, keep=["id"])
    return out.select("id", *[r6(c).alias(c) for c in out.columns if c.endswith(names)])


@query("scale_by_split", _own_split(["mn"], "id", "true"))
def scale_by_split(spark, sf_dir):
    return _split_scaled(spark, sf_dir, False, None, "_mn")


@query("square_scaled", _own_split(["mn_sq"], "id", "true"))
def square_scaled(spark, sf_dir):
    return _split_scaled(spark, sf_dir, True, None, "_mn_sq")


@query("product_scaled", _own_split(["prod"], "id", "true"))
def product_scaled(spark, sf_dir):
    return _split_scaled(spark, sf_dir, False, "f5", "_prod")


@query(
    "feature_table_train",
    _own_split(["mn", "mn_sq", "prod"], f"id, validation, target, {_BITS}", "not tournament"),
)
def feature_table_train(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    return _round_features(ts.feature_table(table, "train"), ["id", "validation", "target"])


@query("feature_table_test", _own_split(["mn", "mn_sq", "prod"], f"id, {_BITS}", "tournament"))
def feature_table_test(spark, sf_dir):
    return _round_features(ts.feature_table(ts.materialize(rows(spark, sf_dir)), "test"), ["id"])


# The flagship: training statistics applied to the tournament rows, two
# scaled features squashed to (0, 1) and blended into a submission.
_SQUASH = "1 / (1 + exp(-({x})))"


@query(
    "submission_standin",
    f"""with s as (select {_STATS} from training where validation = 0)
    select t_id, {s6('(' + _SQUASH.format(x='(f1 - m_f1) / nullif(sd_f1, 0)') + ' + '
                     + _SQUASH.format(x='(f13 - m_f13) / nullif(sd_f13, 0) + ((cast(substr(c1, 3) as int) >> 4) & 1)')
                     + ') / 2')} as probability from tourn, s""",
)
def submission_standin(spark, sf_dir):
    from pyspark.sql import functions as F

    scaled = ts.scaled_tournament(
        ts.materialize(rows(spark, sf_dir)), {"m2": "not tournament and validation = 0"}
    )
    scores = scaled.select(
        "t_id",
        (1 / (1 + F.exp(-F.col("f1_m2")))).alias("p1"),
        (1 / (1 + F.exp(-(F.col("f13_m2") + F.col("c_1"))))).alias("p2"),
    )
    return scores.select("t_id", r6(ts.blend_mean("p1", "p2")).alias("probability"))
