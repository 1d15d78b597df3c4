"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cuckoo, decontam, lm, minhash, quality, secrets, sharding, substring, warc
from .common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def llm_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of exact dedup: insertions, deletions, resizing and verified probes."""
    return cuckoo.exact_index(spark, table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_sharding": sharding.op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "pipeline": pipeline,
    "llm_exact_index": llm_exact_index,
}

ORACLE_SQL: dict[str, str] = {"op3_sharding": sharding.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op7_exact_dedup": cuckoo.ORACLE_SQL, "llm_exact_index": cuckoo.INDEX_SQL}
