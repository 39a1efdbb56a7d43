"""Scans, sinks, selection, reshape, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tabscore as ts
from tabscore.catalog.registry import FLIST, query, r6, rounded, s6, standin
from tabscore.sources.scratch import scratch_path
from tabscore.sources.tables import FEATURES, TRAINING_SCHEMA


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.contest(spark, sf_dir)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.training(rows(spark, sf_dir))


def code() -> F.Column:
    return ts.split_code("c1")[1]


# ---- scans and sinks


@query("scan_contest", "select * from contest")
def scan_contest(spark, sf_dir):
    return rows(spark, sf_dir)


def _contract_rows(spark, sf_dir):
    return train(spark, sf_dir).select(*TRAINING_SCHEMA.fieldNames())


@query("roundtrip_csv", f"select {FLIST}, c1, validation, target from training")
def roundtrip_csv(spark, sf_dir):
    path = scratch_path(spark, "training") + ".csv"
    ts.write_features(_contract_rows(spark, sf_dir), path, "csv")
    return ts.read_table(spark, path, TRAINING_SCHEMA)


@query("roundtrip_csv_gz", f"select {FLIST}, c1, validation, target from training")
def roundtrip_csv_gz(spark, sf_dir):
    path = scratch_path(spark, "training") + ".csv.gz"
    ts.write_features(_contract_rows(spark, sf_dir), path, "csv.gz")
    return ts.read_table(spark, path, TRAINING_SCHEMA)


@query("feature_sink", f"select {FLIST}, c1, validation, target from training")
def feature_sink(spark, sf_dir):
    path = scratch_path(spark, "features")
    ts.write_features(_contract_rows(spark, sf_dir), path)
    return ts.read_table(spark, path)


@query("submission_scan", f"select id as t_id, {s6('s2')} as probability from standin where tournament")
def submission_scan(spark, sf_dir):
    path = scratch_path(spark, "submission")
    scores = standin(rows(spark, sf_dir)).filter("tournament")
    ts.write_submission(scores.select(F.col("id").alias("t_id"), F.col("s2").alias("probability")), path)
    return rounded(ts.read_submission(spark, path), "probability")


@query(
    "submission_sink",
    f"select id as t_id, {s6('(s1 + s2 + s3) / 3')} as probability from standin where tournament",
)
def submission_sink(spark, sf_dir):
    path = scratch_path(spark, "submission")
    scores = standin(rows(spark, sf_dir)).filter("tournament")
    blended = ts.blend(scores, {"p": ts.equal("s1", "s2", "s3")})
    ts.write_submission(blended, path, key="id", probability="p")
    return rounded(ts.read_submission(spark, path), "probability")


# ---- selection


@query("drop_keys", f"select {FLIST}, c1 from training")
def drop_keys(spark, sf_dir):
    return train(spark, sf_dir).drop("id", "validation", "target")


@query("select_prefix", f"select {FLIST} from training")
def select_prefix(spark, sf_dir):
    df = train(spark, sf_dir)
    return df.select(ts.cols_starting(df, "F"))


_STATS = ", ".join(f"avg({f}) as m_{f}, stddev_samp({f}) as sd_{f}" for f in FEATURES)


def z_sql(f: str, suffix: str = "", stats: str = "s") -> str:
    return f"{s6(f'({f} - {stats}.m_{f}) / nullif({stats}.sd_{f}, 0)')} as {f}{suffix}"


_ALL_SCALED = f"""with s as (select {_STATS} from training)
select id, {', '.join(z_sql(f, '_m1') for f in FEATURES)} from training, s"""


@query("select_contains", _ALL_SCALED)
def select_contains(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    scaled = ts.scaled_features(table, {"m1": "not tournament", "m2": "not tournament and validation = 0"})
    names = ts.cols_containing(scaled, "M1")
    return rounded(scaled.select("id", *names), *names)


@query("rename_alias", "select id as t_id, f1 as quantity, target as label from training")
def rename_alias(spark, sf_dir):
    df = train(spark, sf_dir).select(F.col("id").alias("t_id"), F.col("f1").alias("quantity"), "target")
    return df.withColumnRenamed("target", "label")


@query("feature_names", f"select {', '.join(f for f in FEATURES if f != 'f5')} from training")
def feature_names(spark, sf_dir):
    df = train(spark, sf_dir)
    return df.select(ts.cols_except(ts.cols_starting(df, "f"), ["f5", "target"]))


@query("filter_validation", "select * from valid")
def filter_validation(spark, sf_dir):
    return train(spark, sf_dir).filter(F.col("validation") == 1)


@query(
    "derived_columns",
    f"""select id, {s6('f4 / cast(f1 as double)')} as price, f2 - f3 as spread,
    {s6('f6 / 100.0 * f4')} as saved from training""",
)
def derived_columns(spark, sf_dir):
    df = train(spark, sf_dir).withColumns(
        {
            "price": r6(F.col("f4") / F.col("f1").cast("double")),
            "spread": F.col("f2") - F.col("f3"),
            "saved": r6(F.col("f6") / 100.0 * F.col("f4")),
        }
    )
    return df.select("id", "price", "spread", "saved")


@query("coalesce_values", "select id, coalesce(f1, f14) as v, coalesce(f4, f13) as w from gaps")
def coalesce_values(spark, sf_dir):
    df = ts.order_features(spark, sf_dir, "left")
    return df.select("id", ts.coalesce_cols("f1", "f14").alias("v"), ts.coalesce_cols("f4", "f13").alias("w"))


@query(
    "row_id",
    "select id, f7, row_number() over (order by f7 desc, id) as n from training",
)
def row_id(spark, sf_dir):
    df = train(spark, sf_dir).select("id", "f7")
    return ts.add_row_id(df, [F.desc("f7"), F.col("id")], "n")


@query(
    "type_conversion",
    """select id, cast(f13 as double) as f13, cast(substr(c1, 3) as int) as code,
    cast(dense_rank() over (order by c1) - 1 as double) as label from training""",
)
def type_conversion(spark, sf_dir):
    df = ts.to_double(train(spark, sf_dir), ["f13"])
    df = ts.index_label(df.select("id", "f13", "c1"), "c1")
    return df.select("id", "f13", code().alias("code"), "label")


@query("assemble", f"select id, 14 as size, cast({' + '.join(FEATURES)} as double) as total from training")
def assemble(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = ts.assemble(train(spark, sf_dir), FEATURES).withColumn("a", vector_to_array("features"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)
    return df.select("id", F.size("a").alias("size"), total.alias("total"))


@query(
    "split_counts",
    """select 'all' as part, count(*) as n from training union all
    select 'train', count(*) from training where validation = 0 union all
    select 'valid', count(*) from valid""",
)
def split_counts(spark, sf_dir):
    train_part, valid_part, all_rows = ts.split_by_flag(ts.materialize(train(spark, sf_dir).select("validation")))

    def size(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")

    return size(all_rows, "all").unionByName(size(train_part, "train")).unionByName(size(valid_part, "valid"))


# ---- reshape, order, unions

_LONG = f"(select id, variable, value from training unpivot (value for variable in ({FLIST})))"


@query("unpivot_features", f"select id, variable, value from {_LONG}")
def unpivot_features(spark, sf_dir):
    return ts.to_long(train(spark, sf_dir), ["id"], FEATURES)


@query(
    "unpivot_keeps_null",
    "select id, variable, value from gaps unpivot include nulls (value for variable in (f1, f5, f13))",
)
def unpivot_keeps_null(spark, sf_dir):
    return ts.to_long(ts.order_features(spark, sf_dir, "left"), ["id"], ["f1", "f5", "f13"])


@query("pivot_ordered", f"select id, {', '.join(f'{f} as {f}_m1' for f in FEATURES)} from training")
def pivot_ordered(spark, sf_dir):
    long = ts.to_long(train(spark, sf_dir), ["id"], FEATURES)
    return ts.order_and_suffix(ts.to_wide(long, "id", FEATURES, "value"), "id", FEATURES, "_m1")


@query("sort_by_id", "select id, f1, f13 from training order by id")
def sort_by_id(spark, sf_dir):
    return train(spark, sf_dir).select("id", "f1", "f13").orderBy("id")


@query("head_rows", "select * from training order by id limit 6")
def head_rows(spark, sf_dir):
    return ts.first_rows(train(spark, sf_dir), "id", 6)


@query(
    "union_fill",
    f"""select id, {FLIST}, c1, validation, target, null::bigint as t_id from training union all
    select null, {FLIST}, c1, null, null, t_id from tourn""",
)
def union_fill(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    return ts.union_fill(ts.training(table), ts.tournament(table))


@query("union_splits", "select id, validation, f1, f13 from training")
def union_splits(spark, sf_dir):
    table = ts.materialize(train(spark, sf_dir).select("id", "validation", "f1", "f13"))
    first, second, _ = ts.split_by_flag(table)
    return ts.union_same(first, second)


# ---- scalar functions


@query("split_code", "select id, c1, split_part(c1, '_', 1) as c2, cast(split_part(c1, '_', 2) as int) as c_num from training")
def split_code(spark, sf_dir):
    token, number = ts.split_code("c1")
    return train(spark, sf_dir).select("id", "c1", token.alias("c2"), number.alias("c_num"))


@query("to_binary", "select id, lpad(bin(cast(substr(c1, 3) as int)), 5, '0') as bits from training")
def to_binary(spark, sf_dir):
    return train(spark, sf_dir).select("id", ts.to_binary(code(), 5).alias("bits"))


_BITS = ", ".join(f"(cast(substr(c1, 3) as int) >> {5 - i}) & 1 as c_{i}" for i in range(1, 6))


@query("bit_columns", f"select id, {_BITS} from contest")
def bit_columns(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir).select("id", "c1", "tournament"))
    encoder = ts.BitEncoder("c1").fit(table.filter("not tournament"))
    return encoder.transform(table).select("id", *encoder.names())


@query(
    "zscore_columns",
    f"select id, {s6('(f1 - 100.0) / 50.0')} as z1, cast(null as double) as z2 from training",
)
def zscore_columns(spark, sf_dir):
    df = train(spark, sf_dir)
    return df.select("id", r6(ts.z("f1", 100.0, 50.0)).alias("z1"), ts.z("f2", F.lit(1.0), F.lit(0.0)).alias("z2"))


@query("square_features", f"select id, {', '.join(f'cast({f} as double) * {f} as {f}_sq' for f in FEATURES)} from training")
def square_features(spark, sf_dir):
    return train(spark, sf_dir).select("id", *[ts.square(f).alias(f"{f}_sq") for f in FEATURES])


_OTHERS = [f for f in FEATURES if f != "f5"]


@query("anchor_product", f"select id, {', '.join(f'cast({f} as double) * f5 as {f}_prod' for f in _OTHERS)} from training")
def anchor_product(spark, sf_dir):
    return train(spark, sf_dir).select("id", *[ts.product(f, "f5").alias(f"{f}_prod") for f in _OTHERS])


@query(
    "format_metric",
    "select c1, printf('%s AUC: %.4f', c1, avg(f14) / 97.0) as text from training group by c1",
)
def format_metric(spark, sf_dir):
    means = train(spark, sf_dir).groupBy("c1").agg((F.avg("f14") / 97.0).alias("m"))
    return means.select("c1", ts.format_metric("%s AUC: %.4f", "c1", "m").alias("text"))


# ---- joins


def _keys_and_scaled(spark, sf_dir):
    table = ts.materialize(rows(spark, sf_dir))
    scaled = ts.Scaler(tuple(FEATURES), {"m1": "not tournament", "m2": "not tournament and validation = 0"}).fit(table)
    training = ts.training(table)
    return training.select("id", "validation", "target"), scaled.transform(training, keep=["id"])


@query(
    "join_features",
    f"""with s as (select {_STATS} from training)
    select id, validation, target, {', '.join(z_sql(f, '_m1') for f in FEATURES)} from training, s""",
)
def join_features(spark, sf_dir):
    keys, feats = _keys_and_scaled(spark, sf_dir)
    names = ts.cols_containing(feats, "_m1")
    return rounded(ts.join_features(keys, feats.select("id", *names), "id"), *names)


@query(
    "join_blocks",
    f"""with s1 as (select {_STATS} from training), s2 as (select {_STATS} from training where validation = 0)
    select id, {', '.join(z_sql(f, '_m1', 's1') for f in FEATURES)},
    {', '.join(z_sql(f, '_m2', 's2') for f in FEATURES)} from training, s1, s2""",
)
def join_blocks(spark, sf_dir):
    _, feats = _keys_and_scaled(spark, sf_dir)
    blocks = [feats.select("id", *ts.cols_containing(feats, p)) for p in ("_m1", "_m2")]
    out = ts.join_blocks(blocks, "id")
    return rounded(out, *[c for c in out.columns if c != "id"])


_LONG_STATS = f"""with long as (select * from {_LONG}),
s as (select variable, avg(value) as m, stddev_samp(value) as sd from long group by variable)"""


@query(
    "scale_long",
    f"""{_LONG_STATS}
    select id, variable, value, {s6('m')} as mean, {s6('sd')} as sd, {s6('(value - m) / nullif(sd, 0)')} as z
    from long left join s using (variable)""",
)
def scale_long(spark, sf_dir):
    long = ts.to_long(ts.materialize(train(spark, sf_dir).select("id", *FEATURES)), ["id"], FEATURES)
    out = ts.lookup_stats(long, ts.variable_stats(long))
    out = out.withColumn("z", ts.z("value", F.col("mean"), F.col("sd")))
    return rounded(out.select("id", "variable", "value", "mean", "sd", "z"), "mean", "sd", "z")


@query(
    "zscore_window",
    f"""{_LONG_STATS}
    select id, variable, {s6('(value - m) / nullif(sd, 0)')} as z from long join s using (variable)""",
)
def zscore_window(spark, sf_dir):
    long = ts.to_long(ts.materialize(train(spark, sf_dir).select("id", *FEATURES)), ["id"], FEATURES)
    return rounded(ts.zscore(long).select("id", "variable", "z"), "z")


@query(
    "anchor_product_long",
    f"""with long as (select * from {_LONG})
    select a.id, a.variable, cast(a.value as double) * b.value as prod
    from long a join long b on a.id = b.id where a.variable <> 'f5' and b.variable = 'f5'""",
)
def anchor_product_long(spark, sf_dir):
    long = ts.to_long(ts.materialize(train(spark, sf_dir).select("id", *FEATURES)), ["id"], FEATURES)
    joined = ts.join_anchor(long, "f5", "id")
    return joined.select("id", "variable", ts.product("value", "anchor_value").alias("prod"))


@query(
    "product_zscore",
    f"""with long as (select * from {_LONG}),
    p as (select a.id, a.variable, cast(a.value as double) * b.value as value
      from long a join long b on a.id = b.id where a.variable <> 'f5' and b.variable = 'f5'),
    s as (select variable, avg(value) as m, stddev_samp(value) as sd from p group by variable)
    select id, variable, {s6('(value - m) / nullif(sd, 0)')} as z from p join s using (variable)""",
)
def product_zscore(spark, sf_dir):
    long = ts.to_long(ts.materialize(train(spark, sf_dir).select("id", *FEATURES)), ["id"], FEATURES)
    return rounded(ts.zscore_product(long, "f5").select("id", "variable", "z"), "z")


@query("bind_predictions", f"select id, {s6('s1')} as s1, {s6('s2')} as s2, {s6('s3')} as s3 from standin where tournament")
def bind_predictions(spark, sf_dir):
    scores = ts.materialize(standin(rows(spark, sf_dir)).filter("tournament"))
    return rounded(ts.bind_by_key([scores.select("id", s) for s in ("s1", "s2", "s3")], "id"), "s1", "s2", "s3")


@query(
    "bind_by_order",
    f"""select row_number() over (order by id) as row_id, id, {s6('s2')} as s2 from standin where tournament""",
)
def bind_by_order(spark, sf_dir):
    scores = ts.materialize(standin(rows(spark, sf_dir)).filter("tournament"))
    keys = scores.select("id")
    bare = scores.select(F.col("id").alias("place"), "s2")
    return rounded(ts.bind_by_order(keys, "id", bare, "place").drop("place"), "s2")


@query(
    "prefix_sums",
    """select id, validation, f7,
    sum(f7) over (partition by validation order by f13, id rows between unbounded preceding and current row)::bigint as f7_cum
    from training""",
)
def prefix_sums(spark, sf_dir):
    df = train(spark, sf_dir).select("id", "validation", "f7", "f13")
    return ts.prefix_sums(df, ["f13", "id"], ["f7"], ["validation"]).drop("f13")
