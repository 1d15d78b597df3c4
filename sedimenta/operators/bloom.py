"""A membership filter per run: never denies a key that the run holds.

Parquet's own bloom filters do this inside the scan (see ``sources.runs``); this operator is for
runs whose filters are wanted as data, such as to choose files before they are opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import bloom_places, fnv32


def build(runs: DataFrame, run: str = "run", key: str = "key", bits: int = 1 << 16) -> DataFrame:
    """(run, word, mask): the filter's set bits, 32 to a word; words without one have no row.

    Partial aggregation combines equal words before the shuffle, so a map task sends at most
    ``bits / 32`` rows per run.
    """
    placed = runs.select(run, F.explode(bloom_places(F.col(key), bits)).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 32 as int))")
    return placed.select(run, F.floor(F.col("place") / 32).cast("int").alias("word"), bit.alias("bit")).groupBy(run, "word").agg(F.bit_or("bit").alias("mask"))


def may_hold(filters: DataFrame, key: bytes, run: str = "run", bits: int = 1 << 16) -> DataFrame:
    """(run): the runs that may hold a key; a run that isn't named surely doesn't."""

    def is_set(place: int) -> Column:
        on = (F.col("word") == place // 32) & (F.col("mask").bitwiseAND(F.lit(1 << (place % 32))) != 0)
        return F.coalesce(F.bool_or(on), F.lit(False))

    places = [fnv32(key, False) % bits, fnv32(key, True) % bits]
    return filters.groupBy(run).agg(reduce(Column.__and__, map(is_set, places)).alias("maybe")).where("maybe").select(run)
