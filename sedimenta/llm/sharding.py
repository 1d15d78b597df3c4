"""Sharding over fixed virtual slots.

A record's key hashes into one of ``SLOTS`` slots, for good. A map says which shard holds each
slot; records move only when the map is edited. Version 0 deals the slots out in turn. A
rebalance looks at the bytes in each slot and edits the map: a shard keeps its slots, in order
of slot, as long as they fit its capacity; the others go, heaviest first, to the shards with
room, dealt along the room that they have. Versions are stored as Parquet, one folder each, and
stay readable.

Everything about slots is a table of ``SLOTS`` rows, however large the data are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

SLOTS, SHARDS = 4096, 64
#: A shard may hold this many hundredths of the mean.
CAPACITY = 105


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5, so any other system finds the same."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of the slots that hold records.

    Map tasks add up per slot, so at most ``slots`` rows of each are shuffled. A null text
    weighs nothing. Rows without key hash as an empty one would.
    """
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0))
    d = docs.select(slot_of(k, slots).alias("slot"), size.cast("long").alias("size"))
    return d.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """(slot, shard, version): version 0, the slots dealt out in turn."""
    return spark.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(old: DataFrame, weights: DataFrame, shards: int = SHARDS, capacity: int = CAPACITY) -> DataFrame:
    """(slot, shard, version): the next version of a map.

    ``capacity`` is in hundredths of the mean bytes of a shard. A shard of the old map that is
    not under ``shards`` any more loses all its slots; new ones start empty. With nothing to
    weigh, or nothing over capacity, the map stays and only its version grows. Slots that no
    shard has room for stay where the deal ends: with the last shard that has room.
    """
    spark = old.sparkSession
    m = old.join(weights.select("slot", F.col("bytes").alias("w")), "slot", "left").withColumn("w", F.coalesce("w", F.lit(0))).coalesce(1)
    cap = F.floor(F.sum("w").over(Window.partitionBy()) * F.lit(capacity) / F.lit(100 * shards))
    m = m.withColumn("cap", cap.cast("long"))
    upto = F.sum("w").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("upto", upto)
    stays = (F.col("shard") < shards) & (F.col("upto") <= F.col("cap"))
    kept = m.where(stays)
    moved = m.where(~stays)
    held = kept.groupBy("shard").agg(F.sum("w").alias("held"))
    caps = m.agg(F.coalesce(F.max("cap"), F.lit(0)).alias("cap"))
    room = spark.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").crossJoin(F.broadcast(caps))  # one row
    room = room.select("shard", (F.col("cap") - F.coalesce("held", F.lit(0))).alias("room")).where("room > 0").coalesce(1)
    w = Window.orderBy(F.col("room").desc(), "shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("hi", F.sum("room").over(w)).withColumn("lo", F.col("hi") - F.col("room"))
    order = Window.orderBy(F.col("w").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.coalesce(1).withColumn("at", F.sum("w").over(order) - F.col("w"))
    # the last shard with room also takes what lies beyond the end
    end = F.when(F.col("hi") == F.max("hi").over(Window.partitionBy()), F.lit(2**62)).otherwise(F.col("hi"))
    room = room.withColumn("end", end)
    target = moved.alias("m").join(F.broadcast(room).alias("r"), (F.col("m.at") >= F.col("r.lo")) & (F.col("m.at") < F.col("r.end")), "left")  # at most ``shards`` rows
    out = kept.select("slot", "shard", "version").union(target.select("slot", F.coalesce("r.shard", F.lit(0)).alias("shard"), "version"))
    return out.select("slot", "shard", (F.col("version") + 1).alias("version"))


class SlotMaps:
    """Versions of a map under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, m: DataFrame) -> int:
        """Stores a version under its number; a number is stored once only. An empty map is refused."""
        m = cut(m.coalesce(1))
        row = m.agg(F.max("version")).first()
        if row[0] is None:
            raise ValueError("a map needs slots")
        m.write.mode("error").parquet(f"{self.folder}/version={row[0]}")
        return row[0]

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}").withColumn("version", F.lit(version))


def assign(docs: DataFrame, m: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard, version) of every row; the map is broadcast: it has ``slots`` rows.

    Rows without key have a null doc_id and the slot of an empty key; repeated rows go to one shard.
    """
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), slot_of(k, slots).alias("slot"))
    return d.join(F.broadcast(m), "slot").select("doc_id", "slot", "shard", "version")


def shard(spark: SparkSession, docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, folder: str | None = None) -> DataFrame:
    """Deals, weighs, rebalances and assigns: the rows of ``assign`` under version 1.

    Both versions are stored in ``folder``, by default one in the folder that executors share. The documents are
    read twice: to weigh the slots, a table of at most ``slots`` rows that is checkpointed, and to assign. An empty
    table weighs nothing and has no rows; texts may be null, empty or of any length; extra columns are ignored.
    """
    maps = SlotMaps(spark, folder or f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}")
    first = maps.save(first_map(spark, slots, shards))
    second = maps.save(rebalanced(maps.load(first), cut(slot_bytes(docs, slots=slots).coalesce(1)), shards))
    return assign(docs, maps.load(second), slots=slots)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot,
         coalesce(strlen(text), 0) AS size
  FROM documents),
slots AS (SELECT i::INTEGER AS slot, (i % {SHARDS})::INTEGER AS shard FROM range({SLOTS}) t(i)),
m AS (
  SELECT slot, shard, w, floor(sum(w) OVER () * {CAPACITY} / {100 * SHARDS}) AS cap,
         sum(w) OVER (PARTITION BY shard ORDER BY slot) AS upto
  FROM (SELECT s.slot, s.shard, coalesce(x.bytes, 0) AS w
        FROM slots s LEFT JOIN (SELECT slot, sum(size) AS bytes FROM d GROUP BY slot) x USING (slot))),
room AS (
  SELECT shard, room, sum(room) OVER (ORDER BY room DESC, shard) AS hi
  FROM (SELECT i::INTEGER AS shard, (SELECT max(cap) FROM m) - coalesce(held, 0) AS room
        FROM range({SHARDS}) t(i)
        LEFT JOIN (SELECT shard, sum(w) AS held FROM m WHERE upto <= cap GROUP BY shard) h ON h.shard = t.i)
  WHERE room > 0),
moved AS (
  SELECT slot, sum(w) OVER (ORDER BY w DESC, slot) - w AS at FROM m WHERE upto > cap),
final AS (
  SELECT slot, shard FROM m WHERE upto <= cap
  UNION ALL
  SELECT v.slot, r.shard FROM moved v JOIN room r
    ON v.at >= r.hi - r.room AND (v.at < r.hi OR r.hi = (SELECT max(hi) FROM room)))
SELECT d.doc_id, d.slot, f.shard, 1::INTEGER AS version FROM d JOIN final f USING (slot)
"""
