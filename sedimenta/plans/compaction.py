"""Flush and leveled compaction as a plan over runs.

New mutations are merged with level 0; the least keys stay as far as its budget goes, the
others move down and are merged with the next level, until one has room. Levels below that
are carried over as they are. The sink takes the rest and drops tombstones, after the merge.
Upper levels hold the newer versions, so any split of keys gives the same answers.

A bounded level is rewritten as a whole, which its budget bounds. Of the sink only files are rewritten
into whose ranges carried keys fall; the others keep their names, however large the sink is.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import part_bytes, split_key
from ..operators.merge import merge
from ..options import Options, Sink
from ..sources import runs
from ..sources.snapshots import File, Snapshot


def _held(df: DataFrame) -> DataFrame:
    """Keeps a merge for the few passes over it; the runs on disk stay its lineage."""
    return df.persist()


def owners(df: DataFrame, files: list[File], number: str = "owner") -> DataFrame:
    """``df`` with the place of the file that each key belongs to: the last that begins at or before it, else the first."""
    begins = [f.lo for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [max(0, bisect.bisect_right(begins, k) - 1) for k in batch.column("key").to_pylist()]
            yield batch.append_column(number, pa.array(at, pa.int32()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(number, T.IntegerType())]))


def flush(options: Options, snapshot: Snapshot, mutations: DataFrame, next_seq: int) -> Snapshot:
    """Writes the files of the version after ``snapshot`` and returns it, not yet published."""
    spark = mutations.sparkSession
    depth = len(options.levels)
    levels = [list(x) for x in snapshot.levels] + [[] for _ in range(depth + 1 - len(snapshot.levels))]
    carry, carried = mutations, None  # rows, and their bytes where they are known
    held = []
    try:
        for i in range(depth):
            here = options.level(i)
            merged = merge([carry, runs.read(spark, [f.path for f in levels[i]])], keep_tombstones=True)
            parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-here.budget // here.run_size)))
            merged = _held(merged.repartitionByRange(parts, "key"))
            held.append(merged)
            totals = part_bytes(merged)
            total = sum(t["n"] for t in totals)
            if total <= here.budget:
                whole = File("", bytes(totals[0]["first"]), bytes(totals[-1]["last"]), total, sum(t["records"] for t in totals)) if totals else None
                levels[i] = _write(merged, options.path, here, total, known=whole) if totals else []
                carry = None
                break
            edge, used, count = split_key(merged, here.budget, totals)
            part = File("", bytes(totals[0]["first"]), bytes(edge), used, count) if edge is not None else None
            levels[i] = _write(merged.where(F.col("key") <= F.lit(edge)), options.path, here, used, known=part) if edge is not None else []
            carry = merged.where(F.col("key") > F.lit(edge)) if edge is not None else merged
            carried = total - used
        if carry is not None:
            levels[depth] = _into_sink(options, levels[depth], carry, carried, held)
    finally:
        for df in held:
            df.unpersist()
    return Snapshot(snapshot.version + 1, next_seq, tuple(map(tuple, levels)))


def _into_sink(options: Options, files: list[File], carry: DataFrame, carried: int | None, held: list[DataFrame]) -> list[File]:
    spark, sink = carry.sparkSession, options.level(len(options.levels))
    if carried is None:
        held.append(carry := _held(carry))
        carried = sum(t["n"] for t in part_bytes(carry))
    touched = {r.owner for r in owners(carry.select("key"), files).select("owner").distinct().collect()} if len(files) > 1 else set(range(len(files)))
    old = [f for i, f in enumerate(files) if i in touched]
    kept = [f for i, f in enumerate(files) if i not in touched]
    merged = merge([carry, runs.read(spark, [f.path for f in old])])
    total = carried + sum(f.bytes for f in old)
    if not kept:
        return _write(merged, options.path, sink, total)
    # files that lie next to each other may be written together, but none across one that is kept
    stretch, group = 0, {}
    for i in range(len(files)):
        stretch += i in touched and i - 1 not in touched
        group[i] = stretch
    grouped = owners(merged, files).withColumn("owner", F.element_at(F.array(*(F.lit(group[i]) for i in range(len(files)))), F.col("owner") + 1))
    return sorted([*kept, *_write(grouped, options.path, sink, total, "owner")], key=lambda f: f.lo)


def _write(df: DataFrame, folder: str, level: Sink, total: int, group: str | None = None, known: File | None = None) -> list[File]:
    return runs.write(df, runs.new_path(folder), level.run_size, level.block_size, total, level.bloom_bits, group, known)
