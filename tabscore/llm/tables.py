"""Shared parts: documents, scratch tables of one job, joins with small tables, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.sources.scratch import delete_path, scratch_path, write_table

# A table of so many narrow rows (tens of megabytes) may be sent to every task.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Tables of one job in a folder that all executors share.

    ``save`` writes a table and reads it back: the lineage ends there, and a lost
    executor costs a re-read. ``drop`` deletes tables that no later step reads;
    ``release_scratch`` deletes the rest when the job's results are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return write_table(df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.root}/{name}")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it has few rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def texts_of(keys: DataFrame) -> DataFrame:
    """Mark keys for a join with the documents' texts by sorting both sides.

    The keys grow with the documents, so they are never broadcast: a job moves the
    texts once whatever its size, and its cost stays in proportion.
    """
    return keys.hint("merge")


def crc(column: str = "doc_id") -> Column:
    """CRC-32 of a column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def components(scratch: Scratch, links: DataFrame, name: str = "links") -> DataFrame:
    """``node, root`` of each linked node: the smallest node that its links reach.

    ``links`` has columns ``a`` and ``b``. Alternating large-star and small-star
    steps (Kiveris et al. 2014) end in one star for each component. A hub is a
    pre-aggregated minimum and a join that Spark can split, never a group.
    """
    edges = scratch.save(links.filter("a <> b").select("a", "b").distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # now every edge points down: a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        edges = scratch.save(star.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
