"""What batch writers of streams share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_id(batch: DataFrame) -> str:
    """Id of the stream that `batch` belongs to. It stays over restarts and is new with a new
    checkpoint, so batches of two streams never share a folder."""
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("not a batch of a running stream")
    return found
