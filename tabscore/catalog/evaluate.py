"""Profiling, metrics, blends, tournament rules."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabscore as ts
from tabscore.catalog.prepare import code, rows, train
from tabscore.catalog.registry import FLIST, query, r6, rounded, s6, standin
from tabscore.operators.metrics import THRESHOLD_METRICS
from tabscore.plans.features import FOUR_POPULATIONS
from tabscore.sources.tables import FEATURES

# ---- counts and statistics


@query("count_by_c1", "select c1, count(*) as n from training group by c1")
def count_by_c1(spark, sf_dir):
    return ts.count_by(train(spark, sf_dir), "c1")


@query("count_by_target", "select target, count(*) as n from training group by target")
def count_by_target(spark, sf_dir):
    return ts.count_by(train(spark, sf_dir), "target")


@query("count_by_split_target", "select validation, target, count(*) as n from training group by all")
def count_by_split_target(spark, sf_dir):
    return ts.count_by(train(spark, sf_dir), "validation", "target")


@query("max_code", "select max(cast(substr(c1, 3) as int)) as max_code from training")
def max_code(spark, sf_dir):
    return ts.max_of(train(spark, sf_dir), code(), "max_code")


_UNPIVOT = "unpivot include nulls (value for variable in ({cols}))"


def _stats_sql(table: str, complete: bool) -> str:
    guard = "case when count(value) = count(*) then {} end" if complete else "{}"
    return f"""select variable, {s6(guard.format('avg(value)'))} as mean, {s6(guard.format('stddev_samp(value)'))} as sd
    from {table} {_UNPIVOT.format(cols=FLIST)} group by variable"""


@query("variable_stats", _stats_sql("training", True))
def variable_stats(spark, sf_dir):
    return rounded(ts.variable_stats(ts.to_long(train(spark, sf_dir), [], FEATURES)), "mean", "sd")


@query("variable_stats_gaps", _stats_sql("gaps", True))
def variable_stats_gaps(spark, sf_dir):
    long = ts.to_long(ts.order_features(spark, sf_dir, "left"), [], FEATURES)
    return rounded(ts.variable_stats(long, "propagate"), "mean", "sd")


@query("variable_stats_skip", _stats_sql("gaps", False))
def variable_stats_skip(spark, sf_dir):
    long = ts.to_long(ts.order_features(spark, sf_dir, "left"), [], FEATURES)
    return rounded(ts.variable_stats(long, "skip"), "mean", "sd")


@query(
    "population_stats",
    "select variable, "
    + ", ".join(
        f"{s6(f'avg(value) filter ({c})')} as m_{p}, {s6(f'stddev_samp(value) filter ({c})')} as sd_{p}"
        for p, c in FOUR_POPULATIONS.items()
    )
    + f" from contest unpivot (value for variable in ({FLIST})) group by variable",
)
def population_stats(spark, sf_dir):
    out = ts.population_stats(rows(spark, sf_dir), FEATURES, FOUR_POPULATIONS)
    return rounded(out, *[c for c in out.columns if c != "variable"])


def _corr_sql(table: str, names: list[str]) -> str:
    parts = []
    for a in names:
        for b in names:
            pair = f"{a} is not null and {b} is not null"
            r = "1.0::double" if a == b else s6(f"corr({a}, {b})")
            ok = f"stddev_pop({a}) filter ({pair}) > 0 and stddev_pop({b}) filter ({pair}) > 0"
            parts.append(f"{{'var_a': '{a}', 'var_b': '{b}', 'corr': case when {ok} then {r} end}}")
    return f"select unnest([{', '.join(parts)}], recursive := true) from {table}"


@query("corr_matrix", _corr_sql("training", FEATURES))
def corr_matrix(spark, sf_dir):
    return rounded(ts.corr_matrix(train(spark, sf_dir), FEATURES), "corr")


@query("corr_gaps", _corr_sql("gaps", ["f1", "f4", "f8", "f13", "f14"]))
def corr_gaps(spark, sf_dir):
    return rounded(ts.corr_matrix(ts.order_features(spark, sf_dir, "left"), ["f1", "f4", "f8", "f13", "f14"]), "corr")


_FULL_CORR = f"with c as ({_corr_sql('training', FEATURES)})"


@query(
    "corr_max",
    f"""{_FULL_CORR} select var_a as variable, {s6('max(case when corr = 1 then 0 else corr end)')} as max_corr
    from c group by var_a""",
)
def corr_max(spark, sf_dir):
    return rounded(ts.corr_max(ts.corr_matrix(train(spark, sf_dir), FEATURES)), "max_corr")


def _plain_corr(names):
    terms = [f"{{'variable': '{a}', 'mean_corr': {s6('(' + ' + '.join(f'corr({a}, {b})' for b in names if b != a) + f') / {len(names)}')}}}" for a in names]
    return f"select unnest([{', '.join(terms)}], recursive := true) from training"


@query("corr_mean", _plain_corr(FEATURES))
def corr_mean(spark, sf_dir):
    return rounded(ts.corr_mean(ts.corr_matrix(train(spark, sf_dir), FEATURES)), "mean_corr")


_SCORES = "(select variable, value from standin unpivot (value for variable in (s1, s2, s3)))"
_PROBS = "[0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]"


@query(
    "quantile_profile",
    f"""with q as (select variable, quantile_cont(value, {_PROBS}) as qs from {_SCORES} group by variable)
    select variable, unnest({_PROBS})::double as prob, {s6('unnest(qs)')} as quantile from q""",
)
def quantile_profile(spark, sf_dir):
    return rounded(ts.quantile_profile(standin(rows(spark, sf_dir)), ["s1", "s2", "s3"]), "quantile")


@query(
    "six_number_summary",
    f"""select variable, {s6('min(value)')} as min, {s6('quantile_cont(value, 0.25)')} as q1,
    {s6('quantile_cont(value, 0.5)')} as median, {s6('avg(value)')} as mean,
    {s6('quantile_cont(value, 0.75)')} as q3, {s6('max(value)')} as max from {_SCORES} group by variable""",
)
def six_number_summary(spark, sf_dir):
    out = ts.six_numbers(standin(rows(spark, sf_dir)), ["s1", "s2", "s3"])
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


def _classes(df):
    return df.select("id", "target", (F.col("f7") > 15).cast("int").alias("pred_a"), (F.col("f6") > 18).cast("int").alias("pred_b"))


_CLASSES = """(select id, target, cast(f7 > 15 as int) as pred_a, cast(f6 > 18 as int) as pred_b from training
where validation = 1)"""


@query("contingency", f"select pred_a, pred_b, count(*) as n from {_CLASSES} group by all")
def contingency(spark, sf_dir):
    valid = train(spark, sf_dir).filter("validation = 1")
    return ts.contingency(_classes(valid), "pred_a", "pred_b")


@query(
    "contingency_wide",
    f"""select pred_a, count(*) filter (target = 0) as "0", count(*) filter (target = 1) as "1"
    from {_CLASSES} group by pred_a""",
)
def contingency_wide(spark, sf_dir):
    valid = train(spark, sf_dir).filter("validation = 1")
    return ts.contingency(ts.materialize(_classes(valid)), "pred_a", "target", wide=True)


@query(
    "histogram_bins",
    f"""with r as (select (max(f13) - min(f13)) / 29.0 as w from training)
    select cast(ceil(f13 / w - 0.5) as bigint) as bin, {s6('max(ceil(f13 / w - 0.5) * w)')} as center, count(*) as n
    from training, r group by 1""",
)
def histogram_bins(spark, sf_dir):
    return rounded(ts.histogram_bins(ts.materialize(train(spark, sf_dir).select("f13")), "f13"), "center")


@query(
    "histogram_width",
    f"""select cast(ceil(s3 / 0.05 - 0.5) as bigint) as bin, {s6('max(ceil(s3 / 0.05 - 0.5) * 0.05)')} as center,
    count(*) as n from standin group by 1""",
)
def histogram_width(spark, sf_dir):
    return rounded(ts.histogram(standin(rows(spark, sf_dir)), "s3", 0.05), "center")


@query(
    "histogram_by_model",
    f"""select variable, cast(ceil(value / 0.001 - 0.5) as bigint) as bin, count(*) as n
    from {_SCORES} group by all""",
)
def histogram_by_model(spark, sf_dir):
    return ts.histogram_by(standin(rows(spark, sf_dir)), ["s1", "s2", "s3"], 0.001)


# ---- metrics

_RANKED = """with r as (select {by}, target as y,
  rank() over (partition by {by} order by {score}) + (count(*) over (partition by {by}, {score}) - 1) / 2.0 as rk
  from {table})"""
_AUC = """(sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0)
  / nullif(cast(count(*) filter (y = 1) as double) * count(*) filter (y = 0), 0)"""


@query(
    "auc_avg_ties",
    f"{_RANKED.format(by='1 as one', score='f7', table='valid').replace('partition by 1 as one', 'partition by 1')} "
    f"select {s6(_AUC)} as auc from r",
)
def auc_avg_ties(spark, sf_dir):
    return rounded(ts.auc(train(spark, sf_dir).filter("validation = 1"), "target", "f7"), "auc")


@query(
    "auc_order_ties",
    f"""with w as (select target as y, row_number() over (order by f7 desc, id)
      - sum(target) over (order by f7 desc, id rows between unbounded preceding and current row) as above from valid)
    select {s6('1 - sum(above * y) / (sum(y) * (count(*) - sum(y))::double)')} as auc from w""",
)
def auc_order_ties(spark, sf_dir):
    valid = train(spark, sf_dir).filter("validation = 1")
    return rounded(ts.auc(valid, "target", "f7", ties="order", order_by="id"), "auc")


@query(
    "auc_fractional",
    f"""with w as (select s3 as y, row_number() over (order by target desc, id)
      - sum(s3) over (order by target desc, id rows between unbounded preceding and current row) as above
      from standin where not tournament and validation = 1)
    select {s6('1 - sum(above * y) / (sum(y) * (count(*) - sum(y)))')} as auc from w""",
)
def auc_fractional(spark, sf_dir):
    valid = standin(rows(spark, sf_dir)).filter("not tournament and validation = 1")
    return rounded(ts.auc(valid, "s3", "target", ties="order", order_by="id", fractional=True), "auc")


def _by_variable(names: list[str], table: str) -> str:
    long = f"(select target, variable, value from {table} unpivot (value for variable in ({', '.join(names)})))"
    return f"{_RANKED.format(by='variable', score='value', table=long)} "


@query("auc_by_score", _by_variable(FEATURES, "valid") + f"select variable, {s6(_AUC)} as auc from r group by variable")
def auc_by_score(spark, sf_dir):
    long = ts.to_long(train(spark, sf_dir).filter("validation = 1"), ["target"], FEATURES)
    return rounded(ts.auc(long, "target", "value", ["variable"]), "auc")


@query("accuracy", f"select {s6('avg(cast(pred_a = target as int))')} as accuracy from {_CLASSES}")
def accuracy(spark, sf_dir):
    return rounded(ts.accuracy(_classes(train(spark, sf_dir).filter("validation = 1")), "target", "pred_a"), "accuracy")


_LOSS = "-ln(case when target = 1 then greatest(s3, 1e-15) else 1 - greatest(s3, 1e-15) end)"
_REPORT = f"""count(*) as n, {s6(f'avg({_LOSS})')} as logloss, {s6('avg((s3 - target) * (s3 - target))')} as mse,
  {s6('avg(cast((s3 > 0.5) = (target = 1) as int))')} as accuracy,
  count(*) filter (s3 > 0.5 and target = 1) as tp, count(*) filter (s3 > 0.5 and target = 0) as fp,
  count(*) filter (s3 <= 0.5 and target = 0) as tn, count(*) filter (s3 <= 0.5 and target = 1) as fn"""


@query(
    "performance_report",
    f"""{_RANKED.format(by='validation', score='s3', table='standin where not tournament')},
    a as (select validation, {s6(_AUC)} as auc from r group by validation),
    p as (select validation, {_REPORT} from standin where not tournament group by validation)
    select * from p join a using (validation)""",
)
def performance_report(spark, sf_dir):
    scores = ts.materialize(standin(rows(spark, sf_dir)).filter("not tournament"))
    report = ts.performance(scores, "target", "s3", by=["validation"])
    return rounded(report, "logloss", "mse", "accuracy", "auc")


@query(
    "performance_total",
    f"""{_RANKED.format(by='tournament', score='s3', table='standin where not tournament')},
    a as (select {s6(_AUC)} as auc from r), p as (select {_REPORT} from standin where not tournament)
    select * from p, a""",
)
def performance_total(spark, sf_dir):
    scores = ts.materialize(standin(rows(spark, sf_dir)).filter("not tournament"))
    return rounded(ts.performance(scores, "target", "s3"), "logloss", "mse", "accuracy", "auc")


# Distinct scores of both splits with the rows at or above each; s1 has many ties.
_SWEEP = """with d as (select validation, s1 as threshold, sum(target)::double as pos, sum(1 - target)::double as neg
    from standin where not tournament group by validation, s1),
  c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over g as p_all, sum(neg) over g as n_all
    from d window w as (partition by validation order by threshold desc), g as (partition by validation)),
  r as (select validation, threshold, pos, neg, tp, fp, n_all - fp as tn, p_all - tp as fn, p_all, n_all from c),
  m as (select *, 2 * tp / nullif(2 * tp + fn + fp, 0) as f1, 5 * tp / nullif(5 * tp + 4 * fn + fp, 0) as f2,
    1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0) as f0point5, (tp + tn) / (tp + fp + tn + fn) as accuracy,
    tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, tn / nullif(tn + fp, 0) as specificity,
    (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) as mcc,
    least(tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) as min_class_accuracy,
    (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as mean_class_accuracy from r)"""
_COUNTS = ", ".join(f"{c}::bigint as {c}" for c in ("tp", "fp", "tn", "fn"))


def _split_scores(spark, sf_dir):
    return ts.materialize(standin(rows(spark, sf_dir)).filter("not tournament"))


@query("threshold_sweep", f"{_SWEEP} select validation, threshold, {_COUNTS}, {', '.join(s6(x) + ' as ' + x for x in THRESHOLD_METRICS)} from m")
def threshold_sweep(spark, sf_dir):
    return rounded(ts.threshold_sweep(_split_scores(spark, sf_dir), "target", "s1", ["validation"]), *THRESHOLD_METRICS)


@query(
    "best_thresholds",
    f"""{_SWEEP}, u as (select * from (select validation, threshold, {_COUNTS}, {', '.join(THRESHOLD_METRICS)} from m)
      unpivot (v for metric in ({', '.join(THRESHOLD_METRICS)}))),
    b as (select *, row_number() over (partition by validation, metric order by v desc, threshold desc) as place from u)
    select validation, metric, {s6('v')} as value, threshold, tp, fp, tn, fn from b where place = 1""",
)
def best_thresholds(spark, sf_dir):
    return rounded(ts.best_thresholds(_split_scores(spark, sf_dir), "target", "s1", ["validation"]), "value")


@query(
    "gains_lift",
    f"""{_SWEEP}, g as (select *, (floor((tp + fp - pos - neg) * 16 / (p_all + n_all)) + 1)::int as part from r),
    t as (select validation, part, sum(pos + neg) as n, sum(pos) as n_pos, min(threshold) as lower, max(tp + fp) as cum_n, max(tp) as cum_pos,
      max(p_all) as p, max(p_all + n_all) as total from g group by validation, part)
    select validation, part as "group", n::bigint as n, n_pos::bigint as n_pos, lower, cum_n::bigint as cum_n, cum_pos::bigint as cum_pos,
      {s6('n_pos / n')} as response, {s6('n_pos / n / (p / total)')} as lift, {s6('n_pos / p')} as capture,
      {s6('cum_pos / cum_n / (p / total)')} as cum_lift, {s6('cum_pos / p')} as cum_capture from t""",
)
def gains_lift(spark, sf_dir):
    out = ts.gains_lift(_split_scores(spark, sf_dir), "target", "s1", 16, ["validation"])
    return rounded(out, "response", "lift", "capture", "cum_lift", "cum_capture")


# Stand-in for boosting rounds: every round adds one column to the raw score.
_ADDED = ["f7", "f6", "f14", "f9", "f12"]


@query(
    "staged_auc",
    f"""with stages as (select target, {', '.join(f"{' + '.join(_ADDED[:i])} as r{i}" for i in range(1, 6))} from valid),
    long as (select target, cast(substr(variable, 2) as int) as round, value
      from stages unpivot (value for variable in (r1, r2, r3, r4, r5))),
    r as (select round, target as y, rank() over (partition by round order by value)
      + (count(*) over (partition by round, value) - 1) / 2.0 as rk from long)
    select round, {s6(_AUC)} as auc from r group by round""",
)
def staged_auc(spark, sf_dir):
    valid = train(spark, sf_dir).filter("validation = 1")
    stages = [sum((F.col(c) for c in _ADDED[1:i]), F.col(_ADDED[0])).alias(str(i)) for i in range(1, 6)]
    long = ts.to_long(valid.select("target", *stages), ["target"], [str(i) for i in range(1, 6)], "round", "value")
    long = long.withColumn("round", F.col("round").cast("int"))
    return rounded(ts.auc(long, "target", "value", ["round"]), "auc")


@query(
    "watchlist",
    f"""with stages as (select target, case when validation = 1 then 'valid' else 'train' end as split,
      {', '.join(f"{' + '.join(_ADDED[:i])} as r{i}" for i in range(1, 6))} from training),
    long as (select target, split, cast(substr(variable, 2) as int) as round, value
      from stages unpivot (value for variable in (r1, r2, r3, r4, r5))),
    r as (select split, round, target as y, rank() over (partition by split, round order by value)
      + (count(*) over (partition by split, round, value) - 1) / 2.0 as rk from long)
    select 'sums' as model_id, round, split, {s6(_AUC)} as metric from r group by split, round""",
)
def watchlist(spark, sf_dir):
    """The metric after each round on both splits, from scores that add one column a round."""
    split = F.when(F.col("validation") == 1, "valid").otherwise("train").alias("split")
    stages = [sum((F.col(c) for c in _ADDED[1:i]), F.col(_ADDED[0])).alias(str(i)) for i in range(1, 6)]
    table = train(spark, sf_dir).select("target", split, *stages)
    long = ts.to_long(table, ["target", "split"], [str(i) for i in range(1, 6)], "round", "score")
    long = long.select("*", F.lit("sums").alias("model_id")).withColumn("round", F.col("round").cast("int"))
    return rounded(ts.metric_history(long), "metric")


@query(
    "early_stop",
    """with h as (select c1 as model_id, f14 as round, avg(f13) as metric from contest group by all),
    m as (select model_id, round, case when count(*) over w = 3 then avg(metric) over w end as smooth from h
      window w as (partition by model_id order by round rows between 2 preceding and current row)),
    b as (select model_id, round,
      max(smooth) over (partition by model_id order by round rows between 2 preceding and current row) as best,
      lag(smooth, 3) over (partition by model_id order by round) as before from m)
    select model_id, min(round) filter (best - before < abs(before) * 0.01) as stop_round from b group by model_id""",
)
def early_stop(spark, sf_dir):
    history = rows(spark, sf_dir).groupBy(F.col("c1").alias("model_id"), F.col("f14").alias("round"))
    return ts.early_stop(history.agg(F.avg("f13").alias("metric")), 3, 0.01)


_BOARD = _by_variable(FEATURES, "valid") + (
    f"select variable as model_id, {s6(_AUC)} as auc from r group by variable order by auc desc, model_id"
)


def _results(spark, sf_dir):
    long = ts.to_long(train(spark, sf_dir).filter("validation = 1"), ["target"], FEATURES, "model_id")
    return rounded(ts.auc(long, "target", "value", ["model_id"]), "auc")


@query("leaderboard", _BOARD)
def leaderboard(spark, sf_dir):
    return ts.leaderboard(_results(spark, sf_dir), "auc")


@query("top_models", _BOARD + " limit 4")
def top_models(spark, sf_dir):
    return ts.leaderboard(_results(spark, sf_dir), "auc", 4)


# ---- blends


def _tournament_scores(spark, sf_dir):
    return standin(rows(spark, sf_dir)).filter("tournament").select(F.col("id").alias("t_id"), "s1", "s2", "s3")


def _blend_sql(**cols: str) -> str:
    return f"select id as t_id, {', '.join(f'{s6(e)} as {n}' for n, e in cols.items())} from standin where tournament"


@query("blend_mean", _blend_sql(probability="(s2 + s3) / 2"))
def blend_mean(spark, sf_dir):
    scores = _tournament_scores(spark, sf_dir)
    return scores.select("t_id", r6(ts.blend_mean("s2", "s3")).alias("probability"))


@query(
    "blend_many",
    _blend_sql(probability1="(s1 + s2) / 2", probability2="(s2 + s3) / 2", probability3="(s1 + s2 + s3) / 3"),
)
def blend_many(spark, sf_dir):
    blends = {
        "probability1": ts.equal("s1", "s2"),
        "probability2": ts.equal("s2", "s3"),
        "probability3": ts.equal("s1", "s2", "s3"),
    }
    out = ts.blend(_tournament_scores(spark, sf_dir), blends)
    return rounded(out.select("t_id", *blends), *blends)


@query("blend_join", _blend_sql(probability="((s1 + s3) / 2 + s2) / 2"))
def blend_join(spark, sf_dir):
    scores = ts.materialize(_tournament_scores(spark, sf_dir))
    first = scores.select("t_id", ts.blend_mean("s1", "s3").alias("prob1"))
    second = scores.select("t_id", F.col("s2").alias("prob2"))
    both = ts.join_predictions(first, second)
    return both.select("t_id", r6(ts.blend_mean("prob1", "prob2")).alias("probability"))


_VOTES = "cast(s1 > 0.25 as int)", "cast(s3 > 0.5 as int)"


def _with_votes(spark, sf_dir):
    return _tournament_scores(spark, sf_dir).withColumns(
        {"svm1": (F.col("s1") > 0.25).cast("int"), "svm2": (F.col("s3") > 0.5).cast("int")}
    ).withColumn("votes", ts.blend_mean("svm1", "svm2"))


@query(
    "blend_weighted",
    _blend_sql(probability2=f"0.98::double * s2 + 0.02::double * ({_VOTES[0]} + {_VOTES[1]}) / 2.0"),
)
def blend_weighted(spark, sf_dir):
    mixed = ts.blend_weighted({"s2": 0.98, "votes": 0.02})
    return _with_votes(spark, sf_dir).select("t_id", r6(mixed).alias("probability2"))


@query(
    "blend_conditional",
    _blend_sql(
        probability3=f"""case when {_VOTES[0]} = {_VOTES[1]}
        then 0.95::double * s2 + 0.05::double * ({_VOTES[0]} + {_VOTES[1]}) / 2.0 else s2 end"""
    ),
)
def blend_conditional(spark, sf_dir):
    out = ts.blend(
        _with_votes(spark, sf_dir),
        {"probability3": {"s2": 0.95, "votes": 0.05}},
        only_if={"probability3": ("svm1", "svm2", "s2")},
    )
    return out.select("t_id", r6("probability3").alias("probability3"))


@query("blend_flipped", _blend_sql(probability="(s2 + (1 - s3)) / 2"))
def blend_flipped(spark, sf_dir):
    out = ts.blend(_tournament_scores(spark, sf_dir), {"probability": ts.equal("s2", "s3")}, flip_cols=["s3"])
    return out.select("t_id", r6("probability").alias("probability"))


# ---- tournament rules


@query(
    "public_private_auc",
    f"""with t as (select target, s2, case when cast('0x' || substr(md5(cast(id as varchar)), 1, 8) as bigint) % 100 < 33 then 'public' else 'private' end as part
      from standin where tournament),
    r as (select part, target as y, rank() over (partition by part order by s2)
      + (count(*) over (partition by part, s2) - 1) / 2.0 as rk from t)
    select part, {s6(_AUC)} as auc from r group by part""",
)
def public_private_auc(spark, sf_dir):
    truth = standin(rows(spark, sf_dir)).filter("tournament")
    sent = truth.select(F.col("id").alias("t_id"), "target", F.col("s2").alias("probability"))
    return rounded(ts.public_private_auc(sent), "auc")


@query(
    "latest_submission_rank",
    """with latest as (select user_id, ts, value from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1)
    select cast(row_number() over (order by value desc, user_id) as int) as rank, user_id, ts, value as auc
    from latest order by value desc, user_id limit 10""",
)
def latest_submission_rank(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("value", "auc")
    return ts.rank_latest(log, "user_id", "ts", "auc", tie="event_id").withColumn("rank", F.col("rank").cast("int"))


@query(
    "validate_submission",
    """with sent as (select l_orderkey as k, count(*) as n, count(*) filter (l_tax * 15 > 1) as big
      from lineitem group by l_orderkey),
    j as (select coalesce(o.o_orderkey, s.k) as t_id, o.o_orderkey as o, s.k, s.n, s.big
      from (select distinct o_orderkey from orders) o full join sent s on s.k = o.o_orderkey)
    select t_id, 'missing' as problem from j where k is null
    union all select t_id, 'unknown' from j where o is null
    union all select t_id, 'duplicate' from j where n > 1
    union all select t_id, 'out_of_range' from j where big > 0""",
)
def validate_submission(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sent = lines.select(F.col("l_orderkey").alias("t_id"), (F.col("l_tax") * 15).alias("probability"))
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("t_id"))
    return ts.validate_submission(sent, ids)
