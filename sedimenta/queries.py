"""Queries over the key/value engine, and the SQL that gives the same rows.

``events`` is read as a mutation log: key ``user_id``, version ``event_id``, value ``value``; an
event of type ``error`` deletes its key. ``orders`` is a base run of unique keys with layers of
updates on top of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import StoreError
from .functions.bytes import bloom_places, compare, ordered_text, record_length
from .operators import blocks, bloom
from .operators import merge as m
from .options import Level, Options, Sink
from .sources import native, runs
from .sources.folders import open_fs, shared
from .store import Table

#: Byte budgets of the levels in the level queries; the rest goes to the sink.
BUDGETS = [20_000, 200_000]


def dead() -> Column:
    return F.col("event_type") == "error"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")


def layers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The log in three layers by ``event_id``; the newest comes first."""
    e = log(spark, sf_dir)
    nth = F.pmod("event_id", F.lit(3))
    return [e.where(nth == i) for i in (2, 1, 0)]


def view(spark: SparkSession, sf_dir: str, keep_tombstones: bool = False) -> DataFrame:
    return m.current(log(spark, sf_dir), ["user_id"], "event_id", dead(), keep_tombstones)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.range_scan(view(spark, sf_dir), 2, 12, "user_id").select("user_id", "event_id", "value")


_SHOW = ("user_id", "event_id", "value")


def kv_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, True).select("user_id", "event_id", "value", "event_type")


def kv_upsert_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by partial aggregation: a deleted key has a null value."""
    e = log(spark, sf_dir).withColumn("live", F.when(~dead(), F.col("value")))
    return m.newest_value(e, ["user_id"], "live", F.col("event_id"))


def kv_delete_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select(*_SHOW)


def _get(key: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: m.get(view(spark, sf_dir), key, "user_id").select(*_SHOW)


def _lookup(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    return m.multi_get([log(spark, sf_dir)], wanted, ["user_id"], "event_id", dead()).select(*_SHOW)


def kv_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of every key that was deleted at some time: what is left of them, whatever older layers hold."""
    return _lookup(spark, sf_dir, log(spark, sf_dir).where(dead()).select("user_id"))


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).where(F.col("user_id") % 7 == 3)
    return _lookup(spark, sf_dir, wanted)


def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.range_scan(view(spark, sf_dir), 10, 40, "user_id").select(*_SHOW)


def kv_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.range_scan(view(spark, sf_dir), name="user_id").select(*_SHOW)


def kv_empty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.range_scan(view(spark, sf_dir), 40, 10, "user_id").select(*_SHOW)


def kv_merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge(layers(spark, sf_dir), ["user_id"], "event_id", dead()).select(*_SHOW)


def kv_merge_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge(layers(spark, sf_dir), ["user_id"], "event_id", dead(), keep_tombstones=True).select(*_SHOW, "event_type")


def order_updates(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Base orders under two layers of updates; of the newer one each fifth row deletes."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    newer = o.where(F.col("o_orderkey") % 11 == 0).select("o_orderkey", (F.col("price") + 2).alias("price"), (F.col("o_orderkey") % 5 == 0).alias("dead"))
    old = o.where(F.col("o_orderkey") % 7 == 0).select("o_orderkey", (F.col("price") + 1).alias("price"), F.lit(False).alias("dead"))
    return [newer, old, o.withColumn("dead", F.lit(False))]


def kv_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge(order_updates(spark, sf_dir), ["o_orderkey"], None, F.col("dead")).select("o_orderkey", "price")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest versions as records: key and value as byte strings, null for a delete."""
    v = view(spark, sf_dir, True)
    key, value = F.encode(F.lpad(F.col("user_id").cast("string"), 10, "0"), "UTF-8"), F.encode(F.col("event_type"), "UTF-8")
    return v.select("user_id", key.alias("key"), F.when(~dead(), value).alias("v"))


def _orders_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.withColumn("bytes", record_length(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")))


def _bytes(e: DataFrame) -> DataFrame:
    """Events as mutations (key, value, seq)."""
    key, value = F.encode(F.lpad(F.col("user_id").cast("string"), 10, "0"), "UTF-8"), F.encode(F.col("value").cast("string"), "UTF-8")
    return e.select(key.alias("key"), F.when(~dead(), value).alias("value"), F.col("event_id").alias("seq"))


def _table(spark: SparkSession, levels: tuple[Level, ...] = (Level(run_size=1_000, max_runs=1), Level(run_size=3_000, max_runs=1)), sink: Sink | None = None, **kw) -> Table:
    return Table(spark, Options(f"{shared(spark)}/table-{uuid.uuid4().hex}", levels, sink or Sink(), **kw))


def _stored(spark: SparkSession, sf_dir: str) -> Table:
    """The layers as three commits of a table with two small levels above the sink."""
    t = _table(spark)
    for layer in reversed(layers(spark, sf_dir)):
        t.apply(_bytes(layer))
    return t


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").cast("long").alias("user_id"), F.col("value").cast("string").cast("double").alias("value"))


def kv_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view through commits, compaction and snapshots."""
    return _shown(_stored(spark, sf_dir).scan())


def kv_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded scan of a stored table that was closed and opened again."""
    t = _stored(spark, sf_dir)
    t.close()
    return _shown(Table(spark, t.options).scan(b"0000000010", b"0000000040"))


def kv_store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups in a stored table through ranges of files, filters and cache: of live, deleted and unknown keys."""
    t = _stored(spark, sf_dir)
    found = [(k, None if v is None else float(v)) for k in (2, 7, 11, 10**9) for v in [t.get(b"%010d" % k)]]
    return spark.createDataFrame(found, "user_id long, value double")


def kv_store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys looked up in a stored table."""
    wanted = _read(spark, sf_dir, "customer").where(F.col("c_custkey") % 7 == 3)
    key = F.encode(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), "UTF-8").alias("key")
    return _shown(_stored(spark, sf_dir).multi_get(wanted.select(key)))


def kv_compact_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction leaves in the sink's files: no tombstones, one version of a key, and untouched files as they were.

    The first commit fills several sink files; the others touch keys up to a bound only.
    """
    most = _read(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    t = _table(spark, (), Sink(run_size=3 * most + 1))
    top, mid, base = layers(spark, sf_dir)
    t.apply(_bytes(base))
    before = set(t.snapshot.levels[-1])
    for layer in (mid, top):
        t.apply(_bytes(layer.where(F.col("user_id") <= most // 8)))
    kept = len(before & set(t.snapshot.levels[-1]))
    files = spark.read.schema(m.RECORD).parquet(*t.snapshot.paths(len(t.snapshot.levels) - 1))
    return _shown(files).withColumn("files_kept", F.lit(kept > 0))


def kv_level_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which level each order falls into, by the running bytes of all before it in key order."""
    out = blocks.running_bytes(_orders_sized(spark, sf_dir), "o_orderkey", F.col("bytes"))
    return out.select("o_orderkey", "upto", blocks.assign_levels(F.col("upto"), BUDGETS).alias("level"))


def _sink_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, file) of the sink of a table that holds all orders: several files, not overlapping."""
    t = _table(spark, (), Sink(run_size=60_000))
    o = _read(spark, sf_dir, "orders")
    t.apply(o.select(F.encode(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), "UTF-8").alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), F.col("o_orderkey").alias("seq")))
    return runs.files(runs.read(spark, t.snapshot.paths(0)))


def _file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_index(_sink_files(spark, sf_dir), F.col("file"), "key", record_length(F.col("key"), F.col("value")))


def kv_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a stored table's files holds every record once, in ranges that don't overlap and begin and end with the table."""
    i = _file_index(spark, sf_dir).withColumn("next", F.lead("start_key").over(Window.orderBy("start_key")))  # a row for each file
    number = lambda c: c.cast("string").cast("long")
    return i.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), number(F.min("start_key")).alias("first_key"), number(F.max("end_key")).alias("last_key"), F.count(F.when(F.col("next") <= F.col("end_key"), 1)).alias("overlaps"))


def kv_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the one block that holds a key's place, cut to a range around it, through the index of the files."""
    files = _sink_files(spark, sf_dir).persist()  # read for the index and for the records
    index = blocks.block_index(files, F.col("file"), "key", record_length(F.col("key"), F.col("value")))
    found = blocks.blocks_of(index, b"0000000777")
    return files.join(F.broadcast(found.select(F.col("block_id").alias("file"))), "file").where(F.col("key") == b"0000000777").select(F.col("key").cast("string").cast("long").alias("o_orderkey"), F.col("value").cast("string").alias("o_orderpriority"))


def kv_snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older version of a stored table, opened by its number after newer ones were published."""
    t = _table(spark)
    e = log(spark, sf_dir)
    for part in (e.where("event_id <= 500"), e.where("event_id between 501 and 900"), e.where("event_id > 900")):
        t.apply(_bytes(part))
    return _shown(Table(spark, t.options, version=1).scan())


def kv_native_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest versions written as native files and read back through a manifest, a range of keys only."""
    spark.dataSource.register(native.NativeRuns)
    folder = f"{shared(spark)}/native-{uuid.uuid4().hex}".removeprefix("file:")
    current = m.current(_bytes(log(spark, sf_dir)), keep_tombstones=True)
    current.repartitionByRange(3, "key").sortWithinPartitions("key").select("key", "value", F.lit("").alias("file"), F.lit(0).alias("block")).write.format("sorted_runs").mode("append").option("block_size", 256).option("run_size", 2_000).save(folder)
    fs, at = open_fs(folder)
    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.endswith(".sst"))
    native.write_manifest(f"{folder}/manifest1", [names, []])
    got = spark.read.format("sorted_runs").option("manifest", f"{folder}/manifest1").option("start", b"0000000010".hex()).option("end", b"0000000090".hex()).load()
    return _shown(got.where("value is not null"))


def kv_memtable_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.memtable_stats(_records(spark, sf_dir), F.col("key"), F.col("v"))


def kv_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and comparison of byte-string keys, of which some are prefixes of others."""
    k = log(spark, sf_dir).select(F.encode(F.col("user_id").cast("string"), "UTF-8").alias("k")).distinct()
    pivot = F.encode(F.lit("15"), "UTF-8")
    return k.select(ordered_text(F.col("k")).alias("key_hex"), compare(F.col("k"), pivot).alias("against_15"), record_length(F.col("k"), F.lit(None).cast("binary")).alias("record_bytes")).orderBy("key_hex")


def kv_validate_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table with small limits says to the events of each kind: taken, or the rule that refuses the batch."""
    small = dict(block_size=64, run_size=1 << 20, cache_size=64)
    t = _table(spark, (), Sink(**small), key_max=2, value_max=9)
    e = _read(spark, sf_dir, "events")
    text = F.encode(F.col("user_id").cast("string"), "UTF-8")
    kinds = {"fine": (text, F.lit(b"x")), "no keys": (F.lit(None).cast("binary"), F.lit(b"x")), "empty keys": (F.lit(b""), F.lit(b"x")), "large keys": (F.concat(text, F.lit(b"123")), F.lit(b"x")), "empty values": (text, F.lit(b"")), "large values": (text, F.encode(F.rpad("event_type", 10, "x"), "UTF-8")), "deletes": (text, F.lit(None).cast("binary"))}
    said = []
    for kind, (key, value) in kinds.items():
        before = t.snapshot.version
        try:
            t.apply(e.where("user_id < 100").select(key.alias("key"), value.alias("value"), F.col("event_id").alias("seq")))
            why = "taken"
        except StoreError as x:
            why = type(x).__name__
        said.append((kind, why, t.snapshot.version - before))
    return spark.createDataFrame(said, "mutations string, outcome string, versions int")


def kv_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file filter of each layer, over the keys' text."""
    e = log(spark, sf_dir).select(F.pmod("event_id", F.lit(3)).cast("int").alias("run"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key")).distinct()
    return bloom.build(e, bits=4096)


def kv_bloom_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = log(spark, sf_dir).select("user_id").distinct()
    return k.select("user_id", bloom_places(F.encode(F.col("user_id").cast("string"), "UTF-8"), 4096).alias("places"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_upsert_latest": kv_upsert_latest,
    "kv_upsert_latest_value": kv_upsert_latest_value,
    "kv_delete_visible": kv_delete_visible,
    "kv_get_hit": _get(7),
    "kv_get_missing": _get(-1),
    "kv_get_deleted": kv_get_deleted,
    "kv_multi_get": kv_multi_get,
    "kv_range_scan": kv_range_scan,
    "kv_full_scan": kv_full_scan,
    "kv_empty_scan": kv_empty_scan,
    "kv_merge_priority": kv_merge_priority,
    "kv_merge_keep_tombstones": kv_merge_keep_tombstones,
    "kv_merge_orders": kv_merge_orders,
    "kv_compact_sink": kv_compact_sink,
    "kv_store_scan": kv_store_scan,
    "kv_store_range": kv_store_range,
    "kv_store_get": kv_store_get,
    "kv_store_multi_get": kv_store_multi_get,
    "kv_native_round_trip": kv_native_round_trip,
    "kv_level_assign": kv_level_assign,
    "kv_block_index": kv_block_index,
    "kv_block_lookup": kv_block_lookup,
    "kv_snapshot_as_of": kv_snapshot_as_of,
    "kv_memtable_stats": kv_memtable_stats,
    "kv_key_order": kv_key_order,
    "kv_validate_mutations": kv_validate_mutations,
    "kv_bloom": kv_bloom,
    "kv_bloom_places": kv_bloom_places,
}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"
_LIVE = f"SELECT user_id, event_id, value FROM ({_LATEST}) WHERE event_type <> 'error'"
_LAYERED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS n FROM events) WHERE n = 1"
_SIZED = "SELECT o_orderkey, strlen(CAST(o_orderkey AS VARCHAR)) + coalesce(strlen(o_orderpriority), 0) + 2 AS bytes FROM orders"
_VERSION = "SELECT user_id, value FROM ({0}) WHERE event_type <> 'error'"
_FNV = """list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda h, b: {0})::BIGINT"""
_FNV1, _FNV1A = _FNV.format("xor((h * 16777619) % 4294967296, b)"), _FNV.format("(xor(h, b) * 16777619) % 4294967296")

ORACLE_SQL: dict[str, str] = {
    "kv_upsert_latest": f"SELECT user_id, event_id, value, event_type FROM ({_LATEST})",
    "kv_upsert_latest_value": f"SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS live FROM ({_LATEST})",
    "kv_delete_visible": _LIVE,
    "kv_get_hit": f"SELECT * FROM ({_LIVE}) WHERE user_id = 7",
    "kv_get_missing": f"SELECT * FROM ({_LIVE}) WHERE user_id = -1",
    "kv_get_deleted": f"SELECT * FROM ({_LIVE}) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "kv_multi_get": f"SELECT * FROM ({_LIVE}) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3)",
    "kv_range_scan": f"SELECT * FROM ({_LIVE}) WHERE user_id BETWEEN 10 AND 40 ORDER BY user_id",
    "kv_full_scan": f"SELECT * FROM ({_LIVE}) ORDER BY user_id",
    "kv_empty_scan": f"SELECT * FROM ({_LIVE}) WHERE user_id BETWEEN 40 AND 10",
    "kv_merge_priority": f"SELECT user_id, event_id, value FROM ({_LAYERED}) WHERE event_type <> 'error'",
    "kv_merge_keep_tombstones": f"SELECT user_id, event_id, value, event_type FROM ({_LAYERED})",
    "kv_merge_orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price
        FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 5 = 0)""",
    "kv_compact_sink": "SELECT user_id, value, true AS files_kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS n FROM events WHERE event_id % 3 = 0 OR user_id <= (SELECT max(user_id) // 8 FROM events)) WHERE n = 1 AND event_type <> 'error'",
    "kv_store_scan": _VERSION.format(_LAYERED),
    "kv_store_range": f"SELECT * FROM ({_VERSION.format(_LAYERED)}) WHERE user_id BETWEEN 10 AND 40",
    "kv_store_get": f"SELECT k.user_id, v.value FROM (SELECT unnest([2, 7, 11, 1000000000])::BIGINT AS user_id) k LEFT JOIN ({_VERSION.format(_LAYERED)}) v ON v.user_id = k.user_id",
    "kv_store_multi_get": f"SELECT * FROM ({_VERSION.format(_LAYERED)}) WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3)",
    "kv_native_round_trip": f"SELECT * FROM ({_VERSION.format(_LATEST)}) WHERE user_id BETWEEN 10 AND 90",
    "kv_level_assign": f"""SELECT o_orderkey, upto, CASE WHEN upto <= {BUDGETS[0]} THEN 0 WHEN upto <= {sum(BUDGETS)} THEN 1 ELSE 2 END AS level
        FROM (SELECT o_orderkey, CAST(sum(bytes) OVER (ORDER BY o_orderkey) AS BIGINT) AS upto FROM ({_SIZED}))""",
    "kv_block_index": "SELECT count(*) AS records, CAST(sum(12 + strlen(o_orderpriority)) AS BIGINT) AS bytes, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, 0::BIGINT AS overlaps FROM orders",
    "kv_block_lookup": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey = 777",
    "kv_snapshot_as_of": _VERSION.format(_LATEST.replace("FROM events", "FROM events WHERE event_id <= 500")),
    "kv_memtable_stats": f"SELECT count(*) AS entries, CAST(sum(10 + CASE WHEN event_type <> 'error' THEN strlen(event_type) ELSE 0 END) AS BIGINT) AS bytes FROM ({_LATEST})",
    "kv_key_order": """SELECT hex(k) AS key_hex, CASE WHEN k < '15' THEN -1 WHEN k = '15' THEN 0 ELSE 1 END AS against_15, CAST(strlen(k) + 2 AS BIGINT) AS record_bytes
        FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k FROM events) ORDER BY key_hex""",
    "kv_validate_mutations": """SELECT * FROM (VALUES ('fine', 'taken', 1), ('no keys', 'EmptyKeyError', 0), ('empty keys', 'EmptyKeyError', 0), ('large keys', 'KeyTooLargeError', 0),
        ('empty values', 'EmptyValueError', 0), ('large values', 'ValueTooLargeError', 0), ('deletes', 'taken', 1)) t(mutations, outcome, versions)""",
    "kv_bloom": f"""SELECT run, CAST(floor(place / 32) AS INTEGER) AS word, CAST(sum(1::BIGINT << CAST(place % 32 AS INTEGER)) AS BIGINT) AS mask FROM (
        SELECT DISTINCT CAST(event_id % 3 AS INTEGER) AS run, unnest([{_FNV1} % 4096, {_FNV1A} % 4096]) AS place FROM events) GROUP BY ALL""",
    "kv_bloom_places": f"SELECT DISTINCT user_id, [{_FNV1} % 4096, {_FNV1A} % 4096] AS places FROM events",
}
