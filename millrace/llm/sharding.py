"""Sharding by fixed virtual slots; DataFrame functions only.

A record's id is hashed into one of ``n_slots`` virtual slots, for good. What
changes over time is the small slot-to-shard map: it is made from the bytes of
each slot (largest slot first, always to the lightest shard) and stored in
versions, from which records are placed. Rebalancing edits the map, so only the records of edited slots move.

Law: ``bytes`` - shards hold nearly equal bytes. The size of a record is the
UTF-8 length of its text plus one (null: none, so one).

Within a shard, records are numbered without gaps: virtual slots in order, and
records within a slot by id, size and checksum. The numbers are slot bases
(prefix sums over the slot table) plus a rank within the slot, from range
partitions over all records, so no task holds a shard or a slot.

Defined results: a null id is hashed as the word ``null``; rows with the same
id share a slot, and equal rows take its numbers in any order; an empty table
gives no rows. Ids that a large share of all rows have in common land in one
slot; the map then gives that slot a shard of its own as far as it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.runtime import cut, numbered, scratch

SLOTS = 4096


def virtual_slot(key: Column, n_slots: int = SLOTS) -> Column:
    """Slot of a key, from the first 32 bits of its MD5, which other engines compute alike."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_table(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """Rows and bytes of each slot in use: at most ``n_slots`` rows."""
    return records.groupBy(slot).agg(F.count("*").alias("n_rows"), F.sum(size).alias("bytes"))


def assign_slots(slots: DataFrame, n_shards: int, version: int = 1, n_slots: int = SLOTS) -> DataFrame:
    """A first slot-to-shard map of all slots: by falling bytes, each to the shard with the fewest bytes so far; slots without rows go round."""
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("slots"))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("picks")
    )

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == lightest - 1, x - slot["minus"]).otherwise(x))
        pick = F.struct(slot["vslot"].alias("vslot"), (lightest - 1).alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    picks = ordered.select(F.explode(F.aggregate("slots", empty, place)["picks"]).alias("pick")).select(F.col("pick.vslot").alias("used"), "pick.shard")
    every = slots.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(picks, F.col("vslot") == F.col("used"), "left").select("vslot", F.coalesce("shard", (F.col("vslot") % n_shards).cast("int")).alias("shard"), F.lit(version).alias("version"))


def add_shard(slot_map: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, with one more shard: each old shard gives up its smallest slots beyond the new mean."""
    held = slot_map.join(slots, "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mean = slots.agg((F.sum("bytes") / (n_shards + 1)).alias("mean"))
    running = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    over = held.crossJoin(F.broadcast(mean)).withColumn("upto", F.sum("bytes").over(running))  # `mean` is one row
    moved = F.when(F.col("upto") > F.col("mean"), F.lit(n_shards)).otherwise(F.col("shard"))
    return over.select("vslot", moved.cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark, path: str) -> bool:
    """Whether a map has been saved at ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = version if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each record: its size, checksum, virtual slot, shard and number in the shard.

    Records go by the newest version of the map stored at ``map_path``. Where none
    is stored, the first one is made and stored there (in the shared folder if no
    path is given).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col(id_col), n_slots).alias("vslot")
    )
    slots = cut(slot_table(records), "slots")
    if map_path is None or not stored(spark, map_path):
        map_path = map_path or scratch(spark, "slot-map")
        save_map(assign_slots(slots, n_shards, n_slots=n_slots), map_path)
    slot_map = load_map(spark, map_path)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.join(slots, "vslot", "left").withColumn("base", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    bases = F.broadcast(bases.select("vslot", "shard", "version", "base"))  # n_slots rows at most
    ranked = numbered(records, "vslot", "doc_id", "size", "text_crc32")
    starts = Window.orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slots.select("vslot", F.coalesce(F.sum("n_rows").over(starts), F.lit(0)).alias("first"))
    return ranked.join(F.broadcast(firsts), "vslot").join(bases, "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"), "vslot", F.col("version").alias("map_version")
    )
