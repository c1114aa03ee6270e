"""Appending the rows of a stream to a vector index, one shard set for each micro-batch.

A micro-batch that runs again after a failure replaces its rows: keys are updated, not added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearloom.operators.index import VectorIndex


def append_stream(rows: DataFrame, index_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that feeds ``rows`` (columns as at the index's creation) to the index."""

    def put(batch: DataFrame, _: int) -> None:
        VectorIndex.load(batch.sparkSession, index_path).update(batch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
