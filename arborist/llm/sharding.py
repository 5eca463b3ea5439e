"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. The bytes of each slot are
summed, and a slot-to-shard map, stored under a version number, says where each slot lives. The
first map gives the largest slots first, each to the least loaded shard, so sizes come out near
equal (law ``bytes``). Rebalancing edits the latest map: slots leave shards that hold more than
the mean until they don't, and go to the least loaded ones, a new shard included; all other slots
stay. Maps have a row for each virtual slot, a fixed number whatever the data.

Records hash by doc_id and text together, so neither copies of a text nor repeats of an id meet
in one slot; rows that repeat in full hash by their row number too. A row's place in its shard is the rows of the shard's earlier slots plus its place
in its own slot, so no shard is ever sorted in one task.

Defined cases: a null text is empty (16 bytes); null and repeated doc_ids are records like others,
and rows equal in doc_id and text are spread over slots like any other; ties in bytes go by slot
number, then by the lower shard; a very long text is one record of its size; an empty table gives
no row; columns of other names are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shared_path, text_of

VIRTUAL_SLOTS = 4096
OVERHEAD = 16


def records(documents: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, row, virtual_slot of every row."""
    raw = F.encode(text_of(), "UTF-8")
    rows = documents.select("doc_id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = saved(rows.withColumns({"row": F.monotonically_increasing_id(), "hash": F.xxhash64("doc_id", "text_crc32", "size")}))
    repeated = rows.groupBy("hash").count().where("count > 1").select("hash", F.lit(True).alias("repeated"))
    salted = F.when(F.col("repeated"), F.xxhash64("hash", "row")).otherwise(F.col("hash"))
    met = rows.join(repeated, "hash", "left").withColumn("virtual_slot", F.pmod(salted, F.lit(virtual_slots)).cast("int"))
    return met.drop("hash", "repeated")


def slot_bytes(rows: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows: one row for each virtual slot, empty ones included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(virtual_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _least_loaded(slots: Column, loads: Column) -> Column:
    """Array of (virtual_slot, shard): each slot in turn to the shard that is least loaded by then.

    slots: array of (bytes, virtual_slot) in the order to give them; loads: bytes by shard.
    """
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("given"))

    def give(held: Column, slot: Column) -> Column:
        to = F.array_position(held["loads"], F.array_min(held["loads"])) - 1
        return F.struct(
            F.transform(held["loads"], lambda load, i: F.when(i == to, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.array_append(held["given"], F.struct(slot["virtual_slot"].alias("virtual_slot"), to.cast("int").alias("shard"))).alias("given"),
        )

    return F.aggregate(slots, start, give, lambda held: held["given"])


def _largest_first(slots: DataFrame) -> Column:
    return F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))),
        lambda x: F.struct((-x["less"]).alias("bytes"), x["virtual_slot"].alias("virtual_slot")),
    )


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, shard: near-equal bytes from nothing. slots has a fixed number of rows."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    given = slots.agg(_largest_first(slots).alias("slots")).select(F.inline(_least_loaded(F.col("slots"), loads)))
    return given.select("virtual_slot", "shard")


def rebalanced(slots: DataFrame, latest: DataFrame, shards: int) -> DataFrame:
    """The latest map, edited so that shards 0 to shards - 1 come near equal; few slots move."""
    held = slots.join(latest, "virtual_slot")
    mean = slots.agg((F.sum("bytes") / shards).alias("mean"))
    by_chance = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    held = held.crossJoin(mean).withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
    held = held.withColumn("leaves", (F.sum("bytes").over(by_chance) <= F.col("load") - F.col("mean")) | (F.col("shard") >= shards))
    stays = held.where(~F.col("leaves"))
    every = slots.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(stays.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads")
    )
    moved = held.where("leaves").agg(_largest_first(held).alias("slots")).crossJoin(loads)
    moved = moved.select(F.inline(_least_loaded(F.col("slots"), F.col("loads"))))
    return stays.select("virtual_slot", "shard").unionByName(moved.select("virtual_slot", "shard"))


class SlotMap:
    """Versions of a slot-to-shard map, each a folder of Parquet at a shared path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "slot-map")

    def write(self, version: int, slots: DataFrame) -> DataFrame:
        slots.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")


def assign(rows: DataFrame, slots: DataFrame, shard_of: DataFrame) -> DataFrame:
    """rows with shard and slot, their place in it (from 0, without gaps)."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("rows")
    places = slots.join(shard_of, "virtual_slot").select("virtual_slot", "shard", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row"))
    return rows.withColumn("place", within).join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("before") + F.col("place") - 1)


def op8(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and place of every document, under the law ``bytes``."""
    rows = saved(records(documents))
    slots = saved(slot_bytes(rows))
    stored = SlotMap(documents.sparkSession).write(1, first_map(slots, shards))
    return assign(rows, slots, stored).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
