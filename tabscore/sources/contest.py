"""The contest view: one row per order that has line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.sources.tables import FEATURES

KEYS = ["id", "c1", "validation", "target", "tournament"]


def order_features(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Contest rows from ``orders`` and ``lineitem``.

    ``how='left'`` keeps orders without line items; their ``f1..f12`` are NULL.
    All sums run over integers, so no float order effect can change a feature.
    Columns a query does not use are pruned through the aggregate to the scan.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    # counting distinct suppliers beside sums would move the lines twice; dealt by order first, they move once
    items = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("int").alias("f1"),
        F.max("l_quantity").cast("int").alias("f2"),
        F.min("l_quantity").cast("int").alias("f3"),
        F.floor(F.sum(cents) / 100.0).cast("int").alias("f4"),
        F.floor(F.max(cents) / 100.0).cast("int").alias("f5"),
        F.sum(F.round(F.col("l_discount") * 100)).cast("int").alias("f6"),
        F.sum(F.round(F.col("l_tax") * 100)).cast("int").alias("f7"),
        F.count_distinct("l_suppkey").cast("int").alias("f8"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("f9"),
        F.sum("l_linenumber").cast("int").alias("f10"),
        F.count_if(F.col("l_linestatus") == "O").cast("int").alias("f11"),
        F.sum(F.col("l_partkey") % 50).cast("int").alias("f12"),
    )
    return orders.join(items, orders.o_orderkey == items.l_orderkey, how).select(
        F.col("o_orderkey").alias("id"),
        *[F.col(f"f{i}") for i in range(1, 13)],
        F.floor("o_totalprice").cast("int").alias("f13"),
        (F.col("o_custkey") % 97).cast("int").alias("f14"),
        F.concat(F.lit("c_"), (F.col("o_custkey") % 24 + 1).cast("string")).alias("c1"),
        (F.col("o_orderkey") % 5 == 1).cast("int").alias("validation"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        (F.col("o_orderkey") % 10 == 9).alias("tournament"),
    )


def contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contest rows: ``id, f1..f14, c1, validation, target, tournament``."""
    return order_features(spark, sf_dir, "inner")


def training(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("tournament")).drop("tournament")


def tournament(rows: DataFrame) -> DataFrame:
    """Tournament rows under their own key; the hidden ``target`` is left out."""
    return rows.filter(F.col("tournament")).select(F.col("id").alias("t_id"), *FEATURES, "c1")
