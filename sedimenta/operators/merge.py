"""Merging of runs: the newest version of each key, tombstones kept or dropped.

A run holds mutations: key columns, ``value`` columns and a sequence column. A tombstone is a
row on which ``deleted`` is true, or whose value is null when no such column is given. Order
among versions is explicit: the sequence, or the position of the run where runs are layers.
Tombstones are dropped only after the newest version was chosen, so a newer delete always
hides older values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a lookup that are broadcast at most.
KEYS_BROADCAST = 100_000

#: Rows of the engine's own tables.
RECORD = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType(), False)])


def empty(spark: SparkSession, schema: T.StructType = RECORD) -> DataFrame:
    """A scan that yields nothing."""
    return spark.createDataFrame([], schema)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must be total.

    The row number is limited to 1 before the shuffle as well (a group limit), so a map
    task sends one row per key; filters on the keys move below it into the scans.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def newest_value(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """(keys, value): the same by partial aggregation, where one column is all that is wanted.

    ``max_by`` gives null when the newest version is a tombstone.
    """
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def layered(runs: Sequence[DataFrame]) -> DataFrame:
    """Runs in one table with their position as ``__layer``; the first is the newest."""
    return reduce(DataFrame.unionByName, (r.withColumn("__layer", F.lit(i)) for i, r in enumerate(runs)))


def merge(runs: Sequence[DataFrame], keys: Sequence[str] = ("key",), seq: str | None = "seq", dead: Column | None = None, keep_tombstones: bool = False) -> DataFrame:
    """One row per key over all runs.

    Of equal keys the run that comes first wins; within a run the greatest ``seq`` does. ``dead``
    says which rows are tombstones: by default those without ``value``.
    """
    if not runs:
        raise ValueError("no runs to merge")
    order = [F.col("__layer")] + ([F.col(seq).desc()] if seq else [])
    out = newest(layered(runs), keys, order).drop("__layer")
    return out if keep_tombstones else out.where(~F.coalesce(dead if dead is not None else F.col("value").isNull(), F.lit(False)))


def current(log: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq", dead: Column | None = None, keep_tombstones: bool = False) -> DataFrame:
    """The newest version of each key of one mutation log, by ``seq`` alone."""
    return merge([log], keys, seq, dead, keep_tombstones)


def get(view: DataFrame, key: object, name: str = "key") -> DataFrame:
    """The row of one key: at most one; the comparison is pushed into every run's scan."""
    return view.where(F.col(name) == F.lit(key))


def multi_get(runs: Sequence[DataFrame], wanted: DataFrame, keys: Sequence[str] = ("key",), seq: str | None = "seq", dead: Column | None = None) -> DataFrame:
    """The live rows of many keys at once, over runs as in ``merge``; a key asked for twice gives one row.

    The keys are joined into each run before versions are compared, so only rows of wanted keys are shuffled: few
    keys are broadcast, after they were counted; more are joined by the shuffle on the key that the comparison needs too.
    """
    w = wanted.select(*keys).distinct()
    few = w.limit(KEYS_BROADCAST + 1).count() <= KEYS_BROADCAST
    return merge([r.join(F.broadcast(w) if few else w, list(keys), "left_semi") for r in runs], keys, seq, dead)


def range_scan(view: DataFrame, start: object | None = None, end: object | None = None, name: str = "key") -> DataFrame:
    """Rows with ``start <= key <= end`` in order of the key; None leaves that side open."""
    if start is not None:
        view = view.where(F.col(name) >= F.lit(start))
    if end is not None:
        view = view.where(F.col(name) <= F.lit(end))
    return view.orderBy(name)


def memtable_stats(view: DataFrame, key: Column, value: Column) -> DataFrame:
    """(entries, bytes) of the newest versions, tombstones counted with their key alone."""
    size = F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return view.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
