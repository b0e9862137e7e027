"""Sharding by fixed virtual slots.

Every record hashes to one of a fixed number of slots; a small table maps slots to shards. The map is
stored with a version and edited, never rebuilt: a rebalance moves only the slots that an overfull
shard cannot hold, and a new shard takes slots only into itself. Only DataFrame and SQL functions.

The slot table has ``slots`` rows whatever the input, so it may be gathered in one row and broadcast.
Null identifiers hash by the other columns given, so that many of them do not share a slot. Repeated
rows share the slot of their key. An empty table gives an empty result and a map with empty slots.
Columns named like the ones added are replaced; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

SLOTS = 8192


def slot_of(key: Column, *instead: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; ``instead`` is hashed where the key is null."""
    return F.pmod(F.xxhash64(key, *(F.when(key.isNull(), c) for c in instead)), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included, from columns ``virtual_slot`` and ``size``."""
    spark = records.sparkSession
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: as many slots for each shard, one after the other."""
    slot = F.col("id")
    return spark.range(slots).select(
        slot.cast("int").alias("virtual_slot"), F.pmod(slot, F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version")
    )


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with sizes near equal.

    Slots are taken from the largest to the smallest. A slot stays in its shard while that shard is
    below its equal share of the bytes; otherwise it goes to the least loaded shard. ``moved`` marks
    the slots that changed. With a larger ``shards`` than the map has, the new shards fill up.
    """
    row = F.struct(
        (-F.col("bytes")).alias("minus"), F.col("virtual_slot"), F.col("shard").alias("home"), F.col("bytes"), F.col("version")
    )
    gathered = slot_map.join(loads, "virtual_slot").agg(
        F.sort_array(F.collect_list(row)).alias("todo"), (F.sum("bytes") / F.lit(shards)).alias("share")
    )

    def step(state: Column, slot: Column) -> Column:
        stays = F.get(state["load"], slot["home"]) + slot["bytes"] <= F.col("share")
        least = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        to = F.when(stays, slot["home"]).otherwise(least)
        load = F.transform(state["load"], lambda x, i: x + F.when(i == to, slot["bytes"]).otherwise(F.lit(0)))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("to"))
    placed = gathered.select("todo", F.aggregate("todo", start, step).getField("to").alias("to"))
    each = placed.select(F.explode(F.arrays_zip("todo", "to")).alias("x"))
    return each.select(
        F.col("x.todo.virtual_slot").alias("virtual_slot"),
        F.col("x.to").alias("shard"),
        (F.col("x.todo.version") + 1).alias("version"),
        (F.col("x.to") != F.col("x.todo.home")).alias("moved"),
    )


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Adds this version to the stored maps and reads it back; earlier versions stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return slot_map.sparkSession.read.parquet(path)


def current_map(stored: DataFrame) -> DataFrame:
    """The latest version of each slot's entry; the stored maps have ``slots`` rows a version."""
    latest = F.max_by(F.struct("shard", "version"), "version").alias("x")
    return stored.groupBy("virtual_slot").agg(latest).select("virtual_slot", "x.shard", "x.version")


def placed(records: DataFrame, slot_map: DataFrame, loads: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's place in its shard without gaps from 0.

    The place is the number of records in the shard's earlier virtual slots plus the rank in the
    record's own, so no task sorts more than one virtual slot.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    ranked = records.withColumn("_rank", rank)
    out = ranked.join(F.broadcast(starts), "virtual_slot")  # one row per virtual slot: a fixed number
    return out.withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_before", "_rank")


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Puts documents into shards of near-equal bytes; returns one row per document.

    The size of a document is its UTF-8 bytes (a null text has none) plus 16. A map that is there
    already is edited; each call adds one version of it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots=slots).alias("virtual_slot"),
    )
    loads = slot_loads(records, slots)
    spark = docs.sparkSession
    try:
        known = spark.read.parquet(map_path)
    except AnalysisException:  # no map yet
        known = store_map(first_map(spark, shards, slots), map_path)
    edited = rebalanced(current_map(known), loads, shards).drop("moved")
    stored = store_map(edited, map_path)
    return placed(records, current_map(stored), loads, ["doc_id", "text_crc32", "size"])
