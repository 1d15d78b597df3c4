"""Streaming ingest, an extension: every micro-batch is one commit of a table.

A micro-batch is applied under the number that the stream gives it. Should a batch be given again
after a failure, its rows are the same and newer than all before them, so applying it twice
leaves the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Table


def ingest(mutations: DataFrame, table: Table, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts writing a stream of (key, value, seq) into ``table``; a null value deletes.

    ``seq`` orders the mutations within a micro-batch; later micro-batches are newer.
    """

    def commit(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read once for the rules and once for the commit
        try:
            table.apply(held)
        finally:
            held.unpersist()

    w = mutations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
