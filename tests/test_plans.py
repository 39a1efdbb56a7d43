"""What must not appear in a plan at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import tabscore as ts
from conftest import SF
from tabscore.sources.tables import FEATURES

TABLE_QUERIES = [
    "scan_contest", "scale_four", "feature_table_train", "scale_by_split", "corr_matrix", "population_stats",
    "variable_stats", "pivot_ordered", "quantile_profile", "row_id", "prefix_sums", "auc_avg_ties", "auc_order_ties",
    "auc_by_score", "zscore_window", "product_zscore", "histogram_by_model", "validate_submission", "blend_join",
    "public_private_auc", "latest_submission_rank", "bind_by_order",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_inputs(text):
    """For every single-partition exchange, the first operator below it."""
    lines = text.splitlines()
    below = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below.append(next((x for x in lines[i + 1 :] if "Project" not in x and "InputAdapter" not in x), ""))
    return below


VECTORISED = {"corr_matrix"}  # moments of Arrow batches


@pytest.mark.parametrize("name", TABLE_QUERIES)
def test_no_python_no_cross_join_no_global_window(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert not re.search(r"PythonUDF|ArrowEval|MapInPandas|BatchEvalPython", text)
    assert ("MapInArrow" in text) == (name in VECTORISED)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert all("HashAggregate" in line or "TakeOrdered" in line for line in single_partition_inputs(text))


def test_filter_and_columns_reach_the_scan(spark, rows):
    text = plan(ts.training(rows).filter("validation = 1").select("f7"))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(validation,1\)", text)
    assert re.search(r"ReadSchema: struct<f7:int,validation:int,tournament:boolean>", text)


def test_unused_features_are_not_computed(spark):
    text = plan(ts.contest(spark, SF).select("id", "f7"))
    assert "l_suppkey" not in text and "l_extendedprice" not in text


def test_scaling_is_a_narrow_projection(rows):
    scaler = ts.Scaler(tuple(FEATURES), {"m1": "not tournament", "m4": "true"}).fit(rows)
    split = ts.SplitScaler(tuple(FEATURES), {"a": "validation = 0", "b": "validation = 1"}).fit(rows)
    for df in (scaler.transform(rows), split.transform(rows)):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_statistics_are_pre_aggregated_in_one_scan(rows):
    text = plan(ts.population_stats(rows, FEATURES, {"a": "tournament", "b": "true"}))
    assert text.count("FileScan") == 1 and "partial_avg" in text


def test_hot_scores_are_counted_before_the_shuffle(rows):
    text = plan(ts.auc(rows.withColumn("s", F.lit(0.5)), "target", "s"))
    lines = text.splitlines()
    deepest = max(i for i, line in enumerate(lines) if "Exchange" in line)
    assert "HashAggregate" in lines[deepest + 1] and "partial_sum" in lines[deepest + 1]


def test_averaged_auc_exchanges_scores_twice(rows):
    """Once to count them, once for the window; everything after has one row for each range."""
    area = ts.auc(rows, "target", "f7", ["validation"])
    area.collect()
    text = plan(area)
    assert "rangepartitioning" not in text
    assert "ReusedExchange [validation" in text  # the split points read the counted scores, too
    before = text.split("== Initial Plan ==")[0]  # of the split points, what is above is the plan of the rows
    assert before.count("Exchange hashpartitioning(__range") == 1


def test_lookups_by_other_columns_are_not_broadcast(spark):
    long = spark.createDataFrame([(1, 2.0)], "k long, value double")
    from tabscore.operators.joins import lookup_stats

    joined = lookup_stats(long, long.groupBy("k").count(), "k")
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()
    named = lookup_stats(long.withColumn("variable", F.lit("a")), spark.createDataFrame([("a", 1.0)], "variable string, mean double"))
    assert "strategy=broadcast" in named._jdf.queryExecution().analyzed().toString()


def test_ordered_auc_shuffles_the_rows_once(rows):
    text = plan(ts.auc(rows, "target", "f7", ties="order", order_by="id"))
    assert text.count("rangepartitioning") == 1
    assert text.count("Window") <= 2  # only the one over ranges


def test_line_items_move_once(spark):
    from tabscore.sources.contest import order_features

    text = plan(order_features(spark, SF))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1
    assert text.count("Exchange hashpartitioning") + text.count("BroadcastExchange") <= 2
