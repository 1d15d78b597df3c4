"""Session and table helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of ids or digests that are broadcast at most.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, as in tests on one machine, a folder of our own is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sedimenta-"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in the shared folder, whatever file system that is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint: computed once, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, renamed: other columns can't clash.

    Rows without an id or a text have nothing to compare and are left out.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most ``BROADCAST_ROWS`` rows, else as it is, to be joined by shuffle.

    It is counted, so it should be cut off from its lineage; its columns should be narrow.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def unused(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case of letters."""
    taken, name = {c.lower() for c in docs.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, flagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``flagged.doc_id``; rows without an id stay.

    The columns are those of ``docs``, whatever their names. ``flagged`` should be cut off from its lineage.
    """
    name = unused(docs, "drop")
    drop = few(flagged.select(F.col("doc_id").alias(name)))
    return docs.join(drop, docs[f"`{id_col}`"] == drop[name], "left_anti")
