import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabscore.llm import sharding
from tests.llm.fixtures import corpus, documents


def placed(spark, tmp_path, rows, **options):
    return sharding.shard_documents(documents(spark, rows), str(tmp_path / "map"), **options).collect()


def test_every_row_has_a_place_in_a_shard(spark, tmp_path):
    out = placed(spark, tmp_path, None, n_slots=64)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    places, load = defaultdict(list), Counter()
    for r in out:
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert set(places) <= set(range(8))
    for p in places.values():
        assert sorted(p) == list(range(len(p)))


def test_bytes_are_nearly_equal_and_copies_do_not_gather(spark, tmp_path):
    rows = [(i, "same text" if i % 3 else "x" * (i % 50), None, None, None) for i in range(3000)]
    out = placed(spark, tmp_path, rows, n_slots=512)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8


def test_an_empty_table_has_no_rows(spark, tmp_path):
    assert placed(spark, tmp_path, [], n_slots=16) == []


def test_versions_stay_and_a_new_shard_only_takes(spark, tmp_path):
    docs = documents(spark)
    path = str(tmp_path / "map")
    sharding.shard_documents(docs, path, n_slots=64)
    rows = docs.select(F.lit(5).alias("size"), sharding.slot_of("doc_id", "text", n_slots=64).alias("virtual_slot"))
    sizes = sharding.slot_sizes(rows, "size", 64)
    old = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path).collect()}
    sharding.store_map(sharding.add_shard(sharding.read_map(spark, path), sizes, 8), path)
    new = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path).collect()}
    assert {r.version for r in sharding.read_map(spark, path).collect()} == {2}
    assert all(new[s] in (old[s], 8) for s in old) and 8 in new.values()
    assert {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 1).collect()} == old


def test_a_second_run_adds_one_version(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.shard_documents(documents(spark), path, n_slots=16).collect()
    again = sharding.shard_documents(documents(spark), path, n_slots=16).collect()
    maps = spark.read.parquet(path).groupBy("version").count().collect()
    assert sorted((r["version"], r["count"]) for r in maps) == [(0, 16), (1, 16), (2, 16)]
    assert len(again) == len(first)
    for wrong in ({"n_slots": 32}, {"n_slots": 16, "n_shards": 4}):
        with pytest.raises(ValueError, match="not"):
            sharding.shard_documents(documents(spark), path, **wrong)


def brute_places(rows, slot_map):
    """Shard and place of each row from the map alone: rows of a shard by slot, then doc_id, size and CRC."""
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[slot_map[r.virtual_slot]].append(r)
    out = []
    for shard, own in by_shard.items():
        own.sort(key=lambda r: (r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
        out += [(r.doc_id, r.size, r.text_crc32, shard, i) for i, r in enumerate(own)]
    return out


def test_places_are_those_of_a_second_computation(spark, tmp_path):
    out = placed(spark, tmp_path, None, n_slots=32)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.virtual_slot] += r.size
    # the rebalancing fold again, in plain Python
    load, slot_map, mean = [0] * 8, {}, sum(sizes.values()) / 8
    for slot in sorted(range(32), key=lambda s: (-sizes[s], s)):
        home = slot * 8 // 32
        at = home if load[home] + sizes[slot] <= mean else load.index(min(load))
        load[at] += sizes[slot]
        slot_map[slot] = at
    got = sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in out)
    assert got == sorted(map(str, brute_places(out, slot_map)))


def test_rebalancing_a_balanced_map_moves_little(spark, tmp_path):
    spark.range(1).count()
    sizes = spark.range(256).selectExpr("cast(id as int) virtual_slot", "100L bytes", "1L n_rows")
    first = sharding.first_map(spark, 8, 256)
    again = sharding.rebalance(first, sizes, 8)
    assert again.join(first, ["virtual_slot", "shard"]).count() == 256
    hot = sizes.withColumn("bytes", F.expr("case when virtual_slot = 0 then 3200L else bytes end"))
    load = Counter()
    for r in sharding.rebalance(first, hot, 8).join(hot, "virtual_slot").collect():
        load[r.shard] += r.bytes
    assert max(load.values()) <= 3700 and sum(load.values()) == 255 * 100 + 3200


@pytest.mark.parametrize("kind", ["Python", "Pandas", "Arrow", "ExistingRDD"])
def test_only_dataframe_functions(spark, tmp_path, kind):
    out = sharding.shard_documents(documents(spark), str(tmp_path / "map"), n_slots=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert kind not in plan.replace("LogicalRDD", "")
