"""Sign-ups as a stream: the first request for a username gets it, whichever batch it comes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedloom.operators.accounts import new_accounts, sign_up_outcomes
from feedloom.schemas import USERS
from feedloom.sinks.tables import BATCH, WRITER, write_batch
from feedloom.sinks.versions import Folder
from feedloom.streaming.batches import stream_id

ACCOUNTS, OUTCOMES = "accounts", "outcomes"


def names_taken(spark: SparkSession, root: str, writer: str, batch_id: int) -> DataFrame:
    """Usernames of the accounts below `root` that a batch of `writer` finds: not its own, which are there
    when it runs again, nor later ones."""
    labelled = StructType([*USERS, StructField(WRITER, StringType()), StructField(BATCH, LongType())])
    if not Folder(spark, root).names(ACCOUNTS):
        return spark.createDataFrame([], "username string")
    stored = spark.read.schema(labelled).parquet(f"{root}/{ACCOUNTS}")
    before = (F.col(WRITER) != writer) | (F.col(BATCH) < batch_id)
    return stored.where(before).select("username")


def sign_up_stream(
    requests: DataFrame,
    existing: Callable[[SparkSession], DataFrame],
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    at: Column | None = None,
) -> StreamingQuery:
    """Starts the stream over `requests` (request_id, username, name).

    Every batch writes its outcomes and, in a folder of its own too, the accounts it creates. In a batch the smallest
    request_id is first. `existing` is asked once a batch for the accounts from elsewhere. The names of a batch are looked
    up in both tables, of which only the names are read; the stream keeps no state, so it may stop for any
    time, and a batch that runs again decides the same. Two streams must not share a `root` at the same time.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, stream_id(batch)
        taken = existing(spark).select("username").unionByName(names_taken(spark, root, writer, batch_id))
        asked = batch.select("username").distinct()
        outcomes = sign_up_outcomes(batch, taken.join(asked, "username", "left_semi"))
        folder = write_batch(outcomes, f"{root}/{OUTCOMES}", batch_id, writer)
        decided = spark.read.schema(outcomes.schema).parquet(folder)
        created = new_accounts(decided, F.localtimestamp() if at is None else at)
        write_batch(created, f"{root}/{ACCOUNTS}", batch_id, writer)

    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .foreachBatch(decide)
        .start()
    )
