"""Sharding by fixed virtual slots and a versioned map of slots to shards, in DataFrame functions only.

A record's slot is a digest of its id, the same for ever and for any number of shards.  Bytes are summed for each slot,
and a map, a small table of versions, says which shard has which slot.  Rebalancing edits the last version: a shard
keeps slots, large ones first, up to its share; the slots beyond it are let go of and go, large ones first, to the
shard that has least.  The law is ``bytes``: shards hold nearly equal bytes.

A slot that is large beside a shard (one id that very many rows repeat, or rows without an id) is split in parts, and
the map then places its parts; a slot's parts are few, since all parts together can't exceed
``SLOTS`` and some shares of a shard.  Only the map is broadcast, which is of that bounded size.

Places in a shard are numbered without gathering a shard: rows are numbered inside the input partition that they came
from, and begin behind the shard's rows of earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, new_path, stored

SLOTS, SHARDS = 4096, 40
#: Bytes that each record adds to those of its text.
OVERHEAD = 16
#: A slot of more than a shard's share divided by this is split in parts of about that size.
SPLIT = 16


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """The slot of an id; rows without an id share one."""
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, doc_id, size, text_crc32, slot), stored: a row for each row of ``docs``; ``key`` numbers rows, with the partition in its upper half."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return stored(own.withColumn("slot", slot_of(F.col("doc_id"), slots)), "records")


def parts(records: DataFrame, shards: int = SHARDS, split: int = SPLIT) -> DataFrame:
    """(slot, n_parts, by_row): slots that are large beside a shard, the parts that they are split in, and how.

    Rows are told apart by id and text; where rows that agree in both are what makes a slot large, by their number.
    """
    each = records.groupBy("slot").agg(F.sum("size").alias("bytes"))
    share = each.agg((F.sum("bytes") / F.lit(shards * split)).alias("share"))
    large = stored(each.crossJoin(F.broadcast(share)).where("bytes > share").select("slot", "share", F.ceil(F.col("bytes") / F.col("share")).cast("int").alias("n_parts")), "large")
    same = records.join(F.broadcast(large.select("slot", "share")), "slot").groupBy("slot", "share", "doc_id", "text_crc32").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    repeated = same.groupBy("slot").agg(F.max((F.col("n") > 1) & (F.col("bytes") > F.col("share"))).alias("by_row"))
    return large.join(repeated, "slot").select("slot", "n_parts", "by_row")


def in_parts(records: DataFrame, large: DataFrame) -> DataFrame:
    """``records`` with the part of its slot that a row is in, 0 for slots that aren't split."""
    told = F.when(F.col("by_row"), F.xxhash64("key")).otherwise(F.xxhash64("text_crc32", "doc_id", "size"))
    return records.join(F.broadcast(large), "slot", "left").withColumn("part", F.when(F.col("n_parts").isNotNull(), F.pmod(told, F.col("n_parts"))).otherwise(0).cast("int")).drop("n_parts", "by_row")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(slot, part, bytes): what each slot, or part of a split one, holds."""
    return records.groupBy("slot", "part").agg(F.sum("size").alias("bytes"))


def edited(held: DataFrame, shards: int = SHARDS, into: range | None = None) -> DataFrame:
    """(slot, part, shard): a new version of a map.  ``held``: (slot, part, bytes, shard: where the last version has it, or null).

    Slots of a shard stay, large ones first, while they fit in an equal share of all bytes, and the shard's first slot
    stays anyway; the others, and slots that no shard of ``range(shards)`` has, go to the shard with least (ties: the
    first), large ones first.  With ``into`` only those shards take slots: what is let go of beyond an equal share
    stays where it was once these have theirs.
    """
    into = range(shards) if into is None else into
    share = held.agg((F.sum("bytes") / F.lit(shards)).alias("share"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    own = held.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard"))).crossJoin(F.broadcast(share))
    own = own.withColumn("stays", F.col("shard").isNotNull() & ((F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("share")) | (F.row_number().over(order) == 1)))
    each = F.struct((-F.col("bytes")).alias("less"), "slot", "part", "shard", "stays")
    gathered = own.agg(F.array_sort(F.collect_list(each)).alias("all"), F.first("share").alias("share"))
    # one row of at most some thousand slots: a fold over those that are free, with the shards' bytes as its state
    staying = F.filter("all", lambda x: x.stays)
    begun = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter(staying, lambda x: x.shard == k), F.lit(0).cast("bigint"), lambda a, x: a - x.less))
    row = gathered.select("all", "share", begun.alias("begun"))
    takers = lambda sums: F.slice(sums, into.start + 1, len(into))

    def placed(state, x):
        least = F.array_min(takers(state.sums))
        first = F.array_position(takers(state.sums), least).cast("int") - 1 + into.start
        at = F.when(x.shard.isNotNull() & (least >= F.col("share")), x.shard).otherwise(first)
        return F.struct(F.transform(state.sums, lambda b, k: F.when(k == at, b - x.less).otherwise(b)).alias("sums"), F.concat(state.at, F.array(at)).alias("at"))

    start = F.struct(F.col("begun").alias("sums"), F.array().cast("array<int>").alias("at"))
    free = F.filter("all", lambda x: ~x.stays)
    moved = row.select(F.arrays_zip(free.alias("x"), F.aggregate(free, start, placed, lambda s: s.at).alias("at")).alias("moved"), staying.alias("staying"))
    kept = moved.select(F.explode("staying").alias("x")).select("x.slot", "x.part", "x.shard")
    return kept.unionByName(moved.select(F.explode("moved").alias("m")).select("m.x.slot", "m.x.part", F.col("m.at").alias("shard")))


class SlotMaps:
    """Versions of a map in one folder, each a partition of its own; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slot-maps")

    def save(self, version: int, new: DataFrame) -> DataFrame:
        """Write a version (an error if it exists) and read it back."""
        new.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, part int, shard int").parquet(f"{self.path}/version={version}")

    def rebalanced(self, last: int, sizes: DataFrame, shards: int = SHARDS, into: range | None = None) -> DataFrame:
        """Version ``last + 1``: version ``last`` edited for ``sizes`` (slot, part, bytes) and a number of shards."""
        return self.save(last + 1, edited(sizes.join(self.load(last), ["slot", "part"], "left"), shards, into))

    def grown(self, last: int, sizes: DataFrame, shards: int) -> DataFrame:
        """Version ``last + 1`` with one shard more, ``shards`` in all; only that one takes slots."""
        return self.rebalanced(last, sizes, shards, range(shards - 1, shards))


def places(records: DataFrame) -> DataFrame:
    """``records`` (key, shard, ..) with ``place``: gapless from 0 in each shard, in the order of ``key``."""
    own = records.withColumn("from", F.shiftright("key", 33))
    counts = own.groupBy("shard", "from").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("shard", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = own.withColumn("k", F.row_number().over(Window.partitionBy("shard", "from").orderBy("key")) - 1)
    return within.join(begin, ["shard", "from"]).withColumn("place", F.col("begin") + F.col("k")).drop("from", "k", "begin")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, split: int = SPLIT, maps: SlotMaps | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, part, map_version): one row per row of ``docs``.

    ``slot`` is the row's place in its shard, ``virtual_slot`` what its id gives.  Version 0 of the map deals slots out
    by number, version 1 is version 0 edited for the bytes that slots hold; law ``bytes`` holds, so ``grown_shard`` is
    null.  A null text has no bytes; rows without a doc_id, and rows that repeat one, are spread over shards where they
    are many; a text larger than a shard's share leaves its shard the larger; an empty table gives no rows; other
    columns are ignored.
    """
    maps = maps or SlotMaps(docs.sparkSession)
    records = measured(docs, slots)
    large = stored(parts(records, shards, split), "large")
    sizes = stored(slot_bytes(in_parts(records, large)), "slot-bytes")
    maps.save(0, sizes.select("slot", "part", F.pmod(F.col("slot") + F.col("part"), F.lit(shards)).alias("shard")))
    now = maps.rebalanced(0, sizes, shards)
    drop_stored(sizes)
    done = places(in_parts(records, large).join(F.broadcast(now), ["slot", "part"]))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"), "part", F.lit(1).alias("map_version"))
