"""Sharding by fixed virtual slots.

Records hash into thousands of slots; a slot belongs to one shard, and only the
slot-to-shard map changes when shards are rebalanced or added. All on the
main path are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscore.sources.scratch import path_exists

N_SLOTS = 4096


def slot_of(*columns: str, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: a hash of columns that tell records apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def slot_sizes(rows: DataFrame, size: str, n_slots: int = N_SLOTS) -> DataFrame:
    """``virtual_slot, bytes, n_rows`` of every slot, empty ones too."""
    used = rows.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").select(
        "virtual_slot",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: equal runs of slots for each shard."""
    return spark.range(n_slots).select(
        F.lit(0).alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        F.floor(F.col("id") * n_shards / n_slots).cast("int").alias("shard"),
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map, with shards of nearly equal bytes and few slots moved.

    Slots in falling order of bytes: one stays on its shard while that has room
    below the mean load; otherwise it goes to the shard with the least load. The
    fold is over one row that holds the slots, whose number is fixed.
    """
    slots = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("d"), "virtual_slot", "bytes", "shard"))
    )
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("load"),
        F.array().cast("array<int>").alias("at"),
    )

    def step(state: Column, slot: Column, mean: Column) -> Column:
        load = state["load"]
        home = slot["shard"]
        fits = (home < n_shards) & (F.try_element_at(load, home + 1) + slot["bytes"] <= mean)
        least = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        at = F.when(fits, home).otherwise(least)
        return F.struct(
            F.transform(load, lambda x, i: F.when(i == at, x + slot["bytes"]).otherwise(x)).alias("load"),
            F.concat(state["at"], F.array(at)).alias("at"),
        )

    one = slot_map.join(sizes, "virtual_slot").agg(
        F.max("version").alias("version"), slots.alias("slots"), F.sum("bytes").alias("total")
    )
    mean = F.col("total") / F.lit(n_shards)
    dealt = one.select("version", "slots", F.aggregate("slots", zero, lambda s, x: step(s, x, mean))["at"].alias("at"))
    moved = F.transform("slots", lambda x, i: F.struct(x["virtual_slot"].alias("virtual_slot"), F.get("at", i).alias("shard")))
    return dealt.select((F.col("version") + 1).alias("version"), F.inline(moved))


def add_shard(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version with one more shard: slots move only to the new one.

    Each old shard gives up its smallest slots, by a running sum, until it has
    given the new shard's part of its own bytes.
    """
    rising = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    whole = Window.partitionBy("shard")
    marked = slot_map.join(sizes, "virtual_slot").select(
        "*", F.sum("bytes").over(rising).alias("run"), F.sum("bytes").over(whole).alias("all")
    )
    goes = F.col("run") * (n_shards + 1) <= F.col("all")
    return marked.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(goes, n_shards).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the table of maps; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version)


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their ``shard`` and their place in it, ``slot``, gapless from 0.

    Places are numbered inside a virtual slot; a prefix sum over the slots of a
    shard, one row for each slot, says where the slot begins.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("begin")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    # one row for each slot, whose number is fixed
    return numbered.join(F.broadcast(begins), "virtual_slot").select(
        *rows.columns, "shard", (F.col("begin") + F.col("place")).alias("slot")
    )


def shard_documents(
    docs: DataFrame, map_path: str, n_shards: int = 8, n_slots: int = N_SLOTS
) -> DataFrame:
    """Documents on shards of nearly equal bytes, by the latest version of a stored map.

    A path without a map gets version 0; every call adds the next version. A map of another
    number of slots, or with shards beyond ``n_shards``, raises.

    A record's slot hashes its doc_id, text size and text CRC, so neither a
    repeated doc_id nor null ones gather in a slot; rows equal in all three do.
    Null text counts as empty, a size is its UTF-8 bytes plus 1. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("virtual_slot", slot_of("doc_id", "size", "text_crc32", n_slots=n_slots))
    sizes = slot_sizes(rows, "size", n_slots)
    if not path_exists(spark, map_path):
        store_map(first_map(spark, n_shards, n_slots), map_path)
    latest = read_map(spark, map_path)
    slots, last = latest.agg(F.count("*"), F.max("shard")).first()
    if slots != n_slots or last >= n_shards:
        raise ValueError(f"the map at {map_path} has {slots} slots and shards up to {last}, not {n_slots} slots on {n_shards} shards")
    store_map(rebalance(latest, sizes, n_shards), map_path)
    return place(rows, read_map(spark, map_path), sizes, ["doc_id", "size", "text_crc32"])
