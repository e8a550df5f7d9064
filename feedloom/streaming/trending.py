"""Trending hashtags as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.sliding import SlidingWindow, chained_counts, seconds
from feedloom.operators.topk import top_k_per_group
from feedloom.plans.trending import report_text, tag_order, timed_tags
from feedloom.sinks.tables import append_table, write_batch
from feedloom.sources.tables import table_stream
from feedloom.streaming.batches import stream_id
from feedloom.streaming.progress import watermark_of

MARK = "ts timestamp, text string"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keep state on the executors' disks instead of their heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def trending_counts(
    messages: DataFrame, spec: SlidingWindow = SlidingWindow(), delay: str = "1 minute"
) -> DataFrame:
    """`messages(ts, text)` to `window_end, tag, cnt` of closed windows.

    Counts per slot first, then sums slots to windows: one state row per tag and slot
    and one per tag and window, however often a tag occurs.
    """
    timed = messages.select(F.col("ts").cast("timestamp").alias("ts"), "text")
    return chained_counts(timed_tags(timed.withWatermark("ts", delay), "ts"), "ts", "tag", spec)


def with_marks(messages: DataFrame, marks: str) -> DataFrame:
    """`messages` and the marks of a folder: messages without words, which only move the time on."""
    spark = messages.sparkSession
    none = spark.createDataFrame([], MARK)
    # A stream needs its folder to be there.
    append_table(none, marks)
    timed = messages.select(F.col("ts").cast("timestamp").alias("ts"), "text")
    return timed.unionByName(table_stream(spark, marks, none.schema))


def mark_end(
    spark: SparkSession,
    marks: str,
    checkpoint: str,
    spec: SlidingWindow = SlidingWindow(),
    delay: str = "1 minute",
) -> bool:
    """Puts a mark behind the last window that a stopped stream has begun, so that its next run closes all.

    What comes after that run and is older than the mark, by more than `delay`, is late. Returns False, and writes nothing, when
    nothing came since the last mark.
    """
    watermark = watermark_of(spark, checkpoint)
    if watermark is None:
        return False
    wait = F.expr(f"INTERVAL '{delay}'")
    newest = F.lit(watermark).cast("timestamp_ntz").cast("timestamp") + wait
    behind = newest + seconds(spec.length_seconds + spec.slide_seconds) + wait
    mark = spark.range(1).select(newest.alias("newest"), behind.alias("ts"), F.lit("").alias("text"))
    last = spark.read.schema(MARK).parquet(marks).agg(F.max("ts").alias("last"))
    if mark.join(last, F.col("newest") == F.col("last")).count():
        return False
    append_table(mark.select("ts", "text").coalesce(1), marks)
    return True


def trending_stream(
    messages: DataFrame,
    table: str,
    checkpoint: str,
    spec: SlidingWindow = SlidingWindow(),
    k: int = 10,
    delay: str = "1 minute",
    trigger: dict | None = None,
    reports: str | None = None,
    marks: str | None = None,
) -> StreamingQuery:
    """Starts the stream; every closed window arrives whole in one batch.

    The last windows of an input that has ended stay open, as nothing moves the watermark past them: give a
    folder for `marks` from the first start on, and see `drain`.

    Rankings go to `table`, and as printable text to `reports` when given, one
    folder per batch. A batch that is run again replaces its folder. A new checkpoint is
    a new stream, whose windows come beside those of the old one.
    """

    def rank(batch: DataFrame, batch_id: int) -> None:
        ranking = top_k_per_group(batch, ["window_end"], tag_order(), k).select(
            "window_end", "rk", "tag", "cnt"
        )
        writer = stream_id(batch)
        folder = write_batch(ranking, table, batch_id, writer)
        if reports is not None:
            written = batch.sparkSession.read.schema(ranking.schema).parquet(folder)
            write_batch(report_text(written), reports, batch_id, writer)

    if marks is not None:
        messages = with_marks(messages, marks)
    return (
        trending_counts(messages, spec, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(rank)
        .start()
    )


def drain(
    messages: DataFrame,
    table: str,
    checkpoint: str,
    marks: str,
    spec: SlidingWindow = SlidingWindow(),
    k: int = 10,
    delay: str = "1 minute",
    reports: str | None = None,
) -> list[StreamingQuery]:
    """Runs the stream over all that is there now, then closes all windows. Returns the ended runs.

    A run that stopped halfway goes on where it was. More messages may come later, and be drained in turn.
    """
    spark, once = messages.sparkSession, {"availableNow": True}
    runs = []
    while not runs or (len(runs) == 1 and mark_end(spark, marks, checkpoint, spec, delay)):
        runs.append(
            trending_stream(messages, table, checkpoint, spec, k, delay, once, reports, marks)
        )
        runs[-1].awaitTermination()
    return runs


def late_rows(query: StreamingQuery) -> int:
    """Rows the query dropped as later than the watermark, in the kept progress."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
