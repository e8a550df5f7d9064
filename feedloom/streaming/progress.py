"""What a stream has done, outside of the stream: its watermark, and a table of its batches."""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from feedloom.sinks.tables import write_batch
from feedloom.sources.tables import read_batches
from feedloom.schemas import PROGRESS


def watermark_of(spark: SparkSession, checkpoint: str) -> datetime | None:
    """Event time up to which a stopped stream is done, in UTC; None before the first event.

    The stream's offset log has it, one small file a batch.
    """
    metadata = spark.read.text(f"{checkpoint}/offsets").where(F.col("value").startswith("{"))
    millis = F.get_json_object("value", "$.batchWatermarkMs").cast("bigint")
    found = metadata.agg(F.max(millis).alias("millis")).first()["millis"]
    if not found:
        return None
    return datetime.fromtimestamp(found / 1000, timezone.utc).replace(tzinfo=None)


class ProgressTable(StreamingQueryListener):
    """Writes a row for every batch of every stream of the session: rows read, rows that came later than
    the watermark and were dropped, rows of state, and the watermark.

    A batch has its own folder, which it replaces when it runs again. `dropped` counts what reaches the
    state too late, which is counts per slot and tag where a stream counts before.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    def _end_of(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        states = progress.stateOperators
        row = (
            str(progress.id),
            progress.batchId,
            progress.numInputRows,
            sum(s.numRowsDroppedByWatermark for s in states),
            sum(s.numRowsTotal for s in states),
            progress.eventTime.get("watermark"),
        )
        df = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
        write_batch(df, self.path, progress.batchId, str(progress.id))

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all batches of a stream that has ended are written."""
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError("the end of the stream wasn't reported")

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def read(self) -> DataFrame:
        return read_batches(self.spark, self.path, PROGRESS)
