"""From raw documents to token ids: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the folder that the executors share and read again as the next stage's documents, so a lost
executor never costs more than the stage at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import bpe, common, cuckoo, decontam, minhash, quality

STAGES = [
    ("quality", quality.stage_quality),
    ("exact_dedup", cuckoo.stage_exact_dedup),
    ("near_dedup", minhash.stage_near_dedup),
    ("decontaminate", decontam.stage_decontaminate),
    ("tokenize", bpe.stage_tokenize),
]

#: The classifier, signatures and merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: (doc_id, n_bytes, n_tokens, tokens, decoded_ok) of every document that all stages keep.

    Rows without id or text pass every stage but are never copies or contaminated; an empty table gives no rows. What a
    stage has read of its predecessor's folder is deleted once it has written its own.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            common.remove(spark, last)
        last = f"{folder}/{name}"
    return docs
