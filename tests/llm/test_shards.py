"""Sharding: sizes, places and maps against what they must be, hot ids split, versions edited with few moves."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from jobloom.llm import shards

SCHEMA = "doc_id bigint, text string, lang string, slot string, shard string, `a.b` string"


def rows(n=3000):
    rng = random.Random(2)
    out = [(i, "ü" * rng.choice([0, 5, 50, 500, rng.randint(0, 3000)]), "x", None, None, ".") for i in range(n)]
    return out + [(n, None, None, None, None, None), (n + 1, "é" * 5000, None, None, None, None)]


def of(found):
    return found.collect()


def totals(found):
    out = {}
    for r in found:
        out[r.shard] = out.get(r.shard, 0) + r.size
    return out


def check_places(found):
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_sizes_places_and_balance(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    found = of(shards.sharded(docs))
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == want and len(found) == len(want)
    check_places(found)
    sums = totals(found)
    assert set(sums) == set(range(40)) and max(sums.values()) < 1.02 * min(sums.values())
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    again = {r.doc_id: (r.shard, r.virtual_slot) for r in of(shards.sharded(docs.repartition(3)))}
    assert again == {r.doc_id: (r.shard, r.virtual_slot) for r in found}  # an id's shard doesn't hang on the partitions


def test_hot_ids_copies_and_rows_without_an_id_are_spread(spark):
    hot = [(7, "same text" * 20, None, None, None, None)] * 2000 + [(None, "none" * 20, None, None, None, None)] * 1500
    found = of(shards.sharded(spark.createDataFrame(rows(1500) + hot, SCHEMA).repartition(6)))
    check_places(found)
    sums = totals(found)
    assert len(found) == 1502 + 3500 and max(sums.values()) < 1.25 * min(sums.values())
    assert len({r.shard for r in found if r.doc_id == 7}) > 3


def test_empty_and_few(spark):
    assert of(shards.sharded(spark.createDataFrame([], SCHEMA))) == []
    one = of(shards.sharded(spark.createDataFrame([(1, "x" * 100_000, None, None, None, None)], SCHEMA)))
    assert [(r.size, r.slot) for r in one] == [(100_016, 0)]


@pytest.fixture
def held(spark):
    rng = random.Random(4)
    data = [(k, 0, rng.randint(1, 2000)) for k in range(900)] + [(k, p, 3000) for k in range(900, 903) for p in range(4)]
    return spark.createDataFrame(data, "slot int, part int, bytes bigint")


def weights(sizes, placed):
    return {r.shard: r.b for r in sizes.join(placed, ["slot", "part"]).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}


def test_versions_are_edited(spark, held, tmp_path):
    maps = shards.SlotMaps(spark, str(tmp_path / "maps"))
    maps.save(0, held.select("slot", "part", (F.col("slot") % 10).alias("shard")))
    first = maps.rebalanced(0, held, 10)
    assert first.count() == held.count() and first.select("slot", "part").distinct().count() == held.count()
    sums = weights(held, first)
    assert max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())
    was = {(r.slot, r.part): r.shard for r in maps.load(0).collect()}
    moved = sum(was[r.slot, r.part] != r.shard for r in first.collect())
    assert moved < 0.25 * held.count()  # an edit, no new deal
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        maps.save(1, first)
    grown = maps.grown(1, held, 11)
    now, before = {(r.slot, r.part): r.shard for r in grown.collect()}, {(r.slot, r.part): r.shard for r in first.collect()}
    assert {s for k, s in now.items() if s != before[k]} == {10} and set(now) == set(before)
    sums = weights(held, grown)
    assert max(sums.values()) < 1.1 * min(sums.values())
    shrunk = maps.rebalanced(2, held, 9)  # shards 9 and 10 are given up
    assert set(weights(held, shrunk)) == set(range(9))
