"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots. Bytes and rows are summed per slot, and a
map of as many rows as there are slots says which shard holds each slot. Rebalancing edits the
map: a shard gives up slots only above its fair share, and those go, largest first, to the
shard with the least bytes. Every version of the map stays stored. The map and the sums have
one row per virtual slot whatever the input, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.llm.scratch import keep, new_path

SHARDS = 24
VIRTUAL_SLOTS = 4096
ROW_BYTES = 8


def records(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) per row. A null text has size 8 and CRC 0."""
    crc = F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    return found.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(virtual_slots)).cast("int"))


def slot_loads(found: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): one row per slot in use."""
    return found.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(virtual_slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"))


def _dealt(loose: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, shard): loose slots, largest first, each to the shard with the least bytes so far."""
    used = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("used"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")))
    one = loose.agg(order.alias("loose")).crossJoin(F.broadcast(used))
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("used", i), F.lit(0).cast("long"))).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"),
    )

    def place(state, slot):
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == least, x - slot["minus"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.array_append(state["placed"], F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard"))).alias("placed"))

    done = one.select(F.explode(F.aggregate("loose", start, place)["placed"]).alias("x"))
    return done.select("x.virtual_slot", "x.shard")


def rebalance(slots: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, with bytes near equal.

    A shard keeps its largest slots while they fit its fair share of all bytes; the other slots
    with bytes are dealt anew. Slots without bytes stay where they are.
    """
    full = slots.join(F.broadcast(loads), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    fair = full.agg((F.sum("bytes") / shards).alias("fair"))
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = full.withColumn("running", running).crossJoin(F.broadcast(fair)).withColumn("stays", (F.col("running") <= F.col("fair")) | (F.col("bytes") == 0))
    marked = keep(marked, "slots")
    stays, loose = marked.where("stays"), marked.where("not stays")
    moved = stays.select("virtual_slot", "shard").union(_dealt(loose, stays, shards))
    return marked.select("virtual_slot", (F.col("version") + 1).alias("version")).join(F.broadcast(moved), "virtual_slot").select("version", "virtual_slot", "shard")


def grow(slots: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` + 1 shards: the new shard takes slots, no other changes.

    Of each shard, the smallest slots that together hold a (shards + 1)th of its bytes move.
    """
    full = slots.join(F.broadcast(loads), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    order = W.partitionBy("shard").orderBy("bytes", "virtual_slot")
    share = F.sum("bytes").over(W.partitionBy("shard")) / (shards + 1)
    moves = (F.sum("bytes").over(order) <= share) & (F.col("bytes") > 0)
    return full.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moves, shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def store_map(slots: DataFrame, path: str) -> DataFrame:
    """Add the map's version to the stored ones and return it as stored."""
    slots.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return slots.sparkSession.read.parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map of one version, the newest if none is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(found: DataFrame, slots: DataFrame) -> DataFrame:
    """Each record's shard by the map, and its gapless position there.

    A position is the number of rows in the shard's lower virtual slots plus the rank in its
    own slot, so no shard is ever sorted in one task.
    """
    loads = slot_loads(found)
    below = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    where = slots.join(F.broadcast(loads), "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(below, F.lit(0).cast("long")).alias("below"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return found.withColumn("rank", rank).join(F.broadcast(where), "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("below") + F.col("rank")).alias("slot"), "virtual_slot", F.col("version").alias("map_version"))


def shard(docs: DataFrame, shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS, path: str | None = None) -> DataFrame:
    """Shards of near equal bytes for the rows of ``docs`` (doc_id, text).

    Defined cases: a null text counts 8 bytes and CRC 0; a null doc_id is hashed by its text
    alone; equal rows get places next to each other; other columns are ignored; no rows give
    no rows. Both versions of the map are stored under ``path``.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "slot_map")
    found = keep(records(docs, virtual_slots), "records")
    loads = keep(slot_loads(found), "loads")
    store_map(first_map(spark, shards, virtual_slots), path)
    store_map(rebalance(load_map(spark, path, 1), loads, shards), path)
    return assign(found, load_map(spark, path, 2))
