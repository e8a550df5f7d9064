"""Post ingest: each new tweet goes to the tweets table and to the topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.plans.posts import check_texts, tweet_records
from feedloom.sinks.tables import write_batch
from feedloom.sinks.topic import publish, topic_records
from feedloom.sources.topic import TOPIC
from feedloom.streaming.batches import stream_id


def post_stream(
    posts: DataFrame,
    users: Callable[[SparkSession], DataFrame],
    tweets: str,
    checkpoint: str,
    send: Callable[[DataFrame, int], None] | None,
    rejects: str | None = None,
    as_json: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the ingest; with `rejects`, unpostable texts go there instead.

    `users` is asked for the users table once per batch, so that who signs up or changes a
    name while the stream runs is seen.

    The table is written first, one folder per batch, and the topic is sent what the
    table holds. When a batch is run again the folder is replaced, while `send` may
    be called twice with the same batch id.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        # The batch is read for rejects, hot authors and records: keep it meanwhile.
        accepted = batch.persist()
        writer = stream_id(batch)
        try:
            if rejects is not None:
                checked = check_texts(batch)
                problems = checked.where(F.col("problem").isNotNull())
                write_batch(problems, rejects, batch_id, writer)
                accepted = checked.where(F.col("problem").isNull()).drop("problem")
            records = tweet_records(accepted, users(batch.sparkSession))
            folder = write_batch(records, tweets, batch_id, writer)
        finally:
            batch.unpersist()
        if send is not None:
            stored = batch.sparkSession.read.schema(records.schema).parquet(folder)
            send(topic_records(stored, as_json), batch_id)

    return (
        posts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(ingest)
        .start()
    )


def relay_stream(
    tweets: DataFrame,
    checkpoint: str,
    send: Callable[[DataFrame, int], None],
    as_json: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Sends the tweets table itself, read as a stream, to the topic: what was not
    stored is never sent. Use it with a `post_stream` that sends nothing."""
    return (
        tweets.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(lambda batch, batch_id: send(topic_records(batch, as_json), batch_id))
        .start()
    )


def to_topic(servers: str, topic: str = TOPIC) -> Callable[[DataFrame, int], None]:
    return lambda records, _batch_id: publish(records, servers, topic)


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """Stands in for the topic: one folder of messages per batch."""

    def send(records: DataFrame, batch_id: int) -> None:
        write_batch(records, path, batch_id, stream_id(records))

    return send
