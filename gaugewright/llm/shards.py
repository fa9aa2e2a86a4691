"""Sharding over fixed virtual slots.

A record's key is hashed into one of a fixed number of virtual slots; a small versioned table says which shard has
which slot. Adding a shard or rebalancing writes a new version of that table in which some slots have another shard,
so that only records of those slots move. The first version and growing follow from slot and shard count alone;
`rebalance` moves slots by the bytes they hold.

Results: every row gets a shard, rows with a null key too (they share a virtual slot). Places inside a shard are
gapless from 0, ordered by virtual slot, then key, size and checksum; equal rows are interchangeable. A null text has
size 1 and the checksum of no bytes. Empty tables give empty results; other columns pass through `assign`.
Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
PARTS = 64  # a slot's rows are numbered in so many parts, split by content


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn. Columns version, virtual_slot, shard; one row per slot."""
    return spark.range(slots, numPartitions=1).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def latest(maps: DataFrame) -> DataFrame:
    newest = maps.agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(newest), "version", "left_semi")


def grow(mapped: DataFrame) -> DataFrame:
    """Next version, with one shard more: each shard gives it the slots that it has beyond its new fair share."""
    shards = mapped.agg((F.max("shard") + 1).alias("_n"), F.count("*").alias("_slots"))
    own = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot", "_n"), "virtual_slot")
    return (
        mapped.join(F.broadcast(shards))
        .withColumn("_rank", F.row_number().over(own))
        .select(
            (F.col("version") + 1).alias("version"), "virtual_slot",
            F.when(F.col("_rank") > F.ceil(F.col("_slots") / (F.col("_n") + 1)), F.col("_n"))
            .otherwise(F.col("shard")).cast("int").alias("shard"),
        )
    )


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Bytes and rows per virtual slot: at most `slots` rows."""
    return docs.groupBy(virtual_slot(F.col(key), slots).alias("virtual_slot")).agg(
        F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("bytes"), F.count("*").alias("rows"),
    )


def rebalance(mapped: DataFrame, held: DataFrame) -> DataFrame:
    """Next version: slots by which a shard exceeds the mean bytes go to the shards with room.

    Slots that overflow and room that is free are laid along one line of bytes each; where they overlap, the slot moves.
    Both lines have one row per slot at most, so a window without a key is bounded.
    """
    full = mapped.join(held, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mean = full.agg((F.sum("bytes") / F.count_distinct("shard")).alias("_mean"))
    full = full.join(F.broadcast(mean))
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    filled = full.withColumn("_before", F.sum("bytes").over(largest) - F.col("bytes"))
    # Kept are the largest slots that fit; a shard's first slot always stays.
    filled = filled.withColumn("_stays", (F.col("_before") + F.col("bytes") <= F.col("_mean")) | (F.col("_before") == 0))
    line = Window.orderBy(F.desc("bytes"), "virtual_slot")
    moving = filled.filter(~F.col("_stays")).withColumn("_at", F.sum("bytes").over(line) - F.col("bytes") / 2)
    room = (
        filled.groupBy("shard").agg(F.first("_mean").alias("_mean"), F.sum(F.when(F.col("_stays"), F.col("bytes")).otherwise(0)).alias("_kept"))
        .withColumn("_room", F.greatest(F.col("_mean") - F.col("_kept"), F.lit(0.0)))
        .withColumn("_to", F.sum("_room").over(Window.orderBy("shard")))
        .select(F.col("shard").alias("_new"), (F.col("_to") - F.col("_room")).alias("_from"), "_to")
    )
    target = moving.join(F.broadcast(room), (moving["_at"] > room["_from"]) & (moving["_at"] <= room["_to"]))
    moved = target.groupBy("virtual_slot").agg(F.min("_new").alias("_new"))
    return mapped.join(moved, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("_new", "shard").alias("shard")
    )


def save(mapped: DataFrame, path: str) -> None:
    """Adds a version to the stored map; earlier versions stay as they are."""
    mapped.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path)


def assign(docs: DataFrame, mapped: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """The rows with virtual_slot and shard; the map has one row per slot, so it is sent to the rows."""
    own = docs.drop("virtual_slot", "shard", "version").withColumn("virtual_slot", virtual_slot(F.col(key), slots))
    return own.join(F.broadcast(mapped.select("virtual_slot", "shard")), "virtual_slot")


def places(docs: DataFrame, mapped: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Key, size, text_crc32, virtual_slot, shard and slot (place in the shard, gapless from 0) of every row.

    Equal rows are counted before anything moves, and a virtual slot is numbered in parts by content, so a key that
    holds a third of all rows is numbered by many tasks.
    """
    rows = docs.select(
        F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    grouped = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("_n"))
    grouped = assign(grouped, mapped, key, slots).withColumn(
        "_part", F.pmod(F.xxhash64(F.lit(1), F.col(key), "size", "text_crc32"), F.lit(PARTS)).cast("int")
    )
    # At most slots x PARTS rows.
    counts = grouped.groupBy("shard", "virtual_slot", "_part").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("virtual_slot", "_part").orderBy(key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = grouped.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["virtual_slot", "_part"])
    return numbered.select(
        key, "size", "text_crc32", "virtual_slot", "shard",
        F.explode(F.sequence(F.col("_start") + F.col("_before"), F.col("_start") + F.col("_before") + F.col("_n") - 1)).alias("slot"),
    )
