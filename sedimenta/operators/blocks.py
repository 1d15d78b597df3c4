"""Blocks and levels: which keys lie together, and where a level's byte budget ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytes import record_length
from ..sources.folders import shared


def running_bytes(df: DataFrame, order: str, size: Column) -> DataFrame:
    """``df`` with ``upto``: bytes of all rows up to and including this one by ``order``.

    One shuffle brings ranges of the key together; their totals, a row for each, come to the driver and go back as what lies before
    each range, and running sums are taken in place. So no task ever sees all rows. The ranges are equal-count
    quantiles found by sampling; they are checkpointed, so that both uses see the same.
    """
    spark = df.sparkSession
    shared(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__size", size.cast("long")).repartitionByRange(parts, order).sortWithinPartitions(order).checkpoint()
    before, total = {}, 0
    for r in sorted(ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("__size").alias("n")).collect()):
        before[r.part], total = total, total + (r.n or 0)
    schema = T.StructType([f for f in ranged.schema.fields if f.name != "__size"] + [T.StructField("upto", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("__size")
            sums = pc.cumulative_sum(pc.fill_null(batch.column(at), 0), start=upto)
            upto = sums[-1].as_py()
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, sums], schema.names)

    return ranged.mapInArrow(run, schema)


def part_bytes(df: DataFrame, key: str = "key", value: str = "value") -> list[Row]:
    """(part, n, records, first, last) of every partition that has records, in order of the key."""
    rows = df.select(F.spark_partition_id().alias("part"), F.col(key).alias("k"), record_length(F.col(key), F.col(value)).alias("n"))
    found = rows.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records"), F.min("k").alias("first"), F.max("k").alias("last")).collect()
    return sorted(found, key=lambda r: r["first"])


def split_key(df: DataFrame, budget: int, totals: list[Row] | None = None, key: str = "key", value: str = "value") -> tuple[object | None, int, int]:
    """(the greatest key up to which the records fit into ``budget`` bytes, their bytes, their number); None if none does.

    ``df`` must give the same partitions each time, in ranges of the key. Totals of the
    partitions come to the driver; running sums are taken in the one where the budget ends.
    """
    used, count, last = 0, 0, None
    for t in part_bytes(df, key, value) if totals is None else totals:
        if used + t["n"] > budget:
            rows = df.where(F.spark_partition_id() == t["part"]).select(F.col(key).alias("k"), record_length(F.col(key), F.col(value)).alias("n"))
            w = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # of one partition
            found = rows.withColumn("upto", F.sum("n").over(w) + F.lit(used)).where(F.col("upto") <= budget).agg(F.max("k"), F.max("upto"), F.count("k")).first()
            return (found[0], found[1], count + found[2]) if found[2] else (last, used, count)
        used, count, last = used + t["n"], count + t["records"], t["last"]
    return last, used, count


def assign_levels(upto: Column, budgets: list[int]) -> Column:
    """Number of the level that a record falls into, by its running bytes; the sink comes last."""
    total, out = 0, F.lit(len(budgets))
    edges = []
    for i, b in enumerate(budgets):
        total += b
        edges.append((i, total))
    for i, edge in reversed(edges):
        out = F.when(upto <= edge, F.lit(i)).otherwise(out)
    return out


def block_index(df: DataFrame, block: Column, key: str, size: Column) -> DataFrame:
    """(block_id, start_key, end_key, records, bytes): what each block of a run holds."""
    return df.groupBy(block.alias("block_id")).agg(F.min(key).alias("start_key"), F.max(key).alias("end_key"), F.count(F.lit(1)).alias("records"), F.sum(size).cast("long").alias("bytes"))


def blocks_of(index: DataFrame, key: object) -> DataFrame:
    """The blocks whose range holds a key: ``start_key <= key <= end_key``."""
    return index.where((F.col("start_key") <= F.lit(key)) & (F.col("end_key") >= F.lit(key)))
