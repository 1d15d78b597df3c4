"""Runs: immutable Parquet files, each sorted by key, with a filter on the key in every file."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import record_length
from ..operators.merge import RECORD, empty
from .snapshots import File, filesystem


def new_path(folder: str) -> str:
    """A name that no other run has."""
    return f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, run_size: int = 128 << 20, block_size: int = 64 << 10, total: int | None = None, bloom_bits: int = 1 << 20, group: str | None = None, known: File | None = None) -> list[File]:
    """Writes records in ranges of the key, about ``run_size`` bytes to a file, and returns the files in order of the key.

    Files don't overlap and are sorted, so their footers' least and greatest keys, per row group
    and page, say where a key can be; ``block_size`` is the page size, and every row group has a filter on the key
    of at most ``bloom_bits``. ``total`` spares the pass that sums the bytes. Number and size of files follow the data,
    whatever its size. Rows that differ in column ``group``, which isn't kept, don't share a file. ``known`` says what a single
    file will hold, and spares the pass that finds out.
    """
    spark = df.sparkSession
    if total is None:
        total = df.agg(F.sum(record_length(F.col("key"), F.col("value")))).first()[0] or 0
    files = max(1, -(-total // run_size))
    order = [group, "key"] if group else ["key"]
    out = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    w = out.sortWithinPartitions(*order).write.option("parquet.page.size", block_size)
    # the filter's size in bytes is a power of two
    w = w.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.max.bytes", 1 << max(5, (bloom_bits // 8).bit_length() - 1))
    (w.partitionBy(group) if group else w).parquet(path)
    if files == 1 and not group and known is not None:
        jvm, fs, at = filesystem(spark, path)
        (name,) = (x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-"))
        return [known._replace(path=name)]
    sized = read(spark, [path]) if not group else spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(path)
    found = sized.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum(record_length(F.col("key"), F.col("value"))).alias("n"), F.count(F.lit(1)).alias("records")).collect()
    return sorted((File(r.path, bytes(r.lo), bytes(r.hi), r.n, r.records) for r in found), key=lambda f: f.lo)


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All records of some runs; none give an empty table. The schema isn't inferred."""
    return spark.read.schema(RECORD).parquet(*paths) if paths else empty(spark)


def files(df: DataFrame) -> DataFrame:
    """``df`` with ``file``: the path of the file that each record comes from."""
    return df.withColumn("file", F.col("_metadata.file_path"))
