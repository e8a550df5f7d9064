"""Who follows whom, kept up to date from a stream of follow events.

A batch of events becomes one record per pair (see operators.follows), written to a folder of
its own; the stream keeps no state. A snapshot holds the records of all batches up to some
point, one per pair. Who reads takes the snapshot and the batches after it, so what is
read doesn't grow with the age of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.follows import edges_of, follow_records, standing
from feedloom.schemas import FOLLOW_RECORDS, READ_UP_TO
from feedloom.sinks.tables import BATCH, WRITER, replace_table, write_batch
from feedloom.sinks.versions import Folder, Versions
from feedloom.streaming.batches import stream_id

CHANGES, SNAPSHOTS = "changes", "snapshots"


def follow_stream(
    events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the stream; each batch adds the records of the pairs it touched below `root`.

    A batch that is run again replaces its folder. Every batch writes a folder, so the trigger is
    a minute unless told otherwise; `compact` merges the folders.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        records = standing(follow_records(batch))
        write_batch(records, f"{root}/{CHANGES}", batch_id, stream_id(batch))

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .foreachBatch(add)
        .start()
    )


def _snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, int]]:
    """Records of the snapshot, and per stream the last batch that is in it."""
    version = Versions(spark, f"{root}/{SNAPSHOTS}").current()
    if version is None:
        return spark.createDataFrame([], FOLLOW_RECORDS), {}
    upto = spark.read.schema(READ_UP_TO).parquet(f"{version}/upto").collect()
    records = spark.read.schema(FOLLOW_RECORDS).parquet(f"{version}/records")
    return records, {r.writer: r.batch for r in upto}


def _batches(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(stream, batch) of all complete batch folders."""
    folder = Folder(spark, f"{root}/{CHANGES}")
    return [
        (writer.split("=", 1)[1], int(batch.split("=", 1)[1]))
        for writer in folder.names()
        for batch in folder.names(writer)
        if folder.exists(f"{writer}/{batch}/_SUCCESS")
    ]


def _read(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, int]]:
    """One record per pair of all that came so far; per stream the last batch in it."""
    records, upto = _snapshot(spark, root)
    newer = [(w, b) for w, b in _batches(spark, root) if b > upto.get(w, -1)]
    if newer:
        paths = [f"{root}/{CHANGES}/{WRITER}={w}/{BATCH}={b}" for w, b in newer]
        records = records.unionByName(spark.read.schema(FOLLOW_RECORDS).parquet(*paths))
    for writer, batch in newer:
        upto[writer] = max(batch, upto.get(writer, -1))
    return standing(records), upto


def followed_edges(spark: SparkSession, root: str) -> DataFrame:
    """The edges that stand now, with since_ts and since_seq, which order the lists."""
    return edges_of(_read(spark, root)[0])


def compact(spark: SparkSession, root: str) -> str:
    """Makes a new snapshot of the last one and all batches since, then deletes those batches.

    Batches of a stream come one after the other, so the last one in the snapshot tells all that are. A batch
    that a restarted stream writes again after that is older than the snapshot and isn't read. The snapshot
    before stays for those who are reading it; batches go only when two snapshots hold them.
    """
    versions = Versions(spark, f"{root}/{SNAPSHOTS}")
    _, before = _snapshot(spark, root)
    records, upto = _read(spark, root)
    version = versions.begin()
    replace_table(records, f"{version}/records")
    replace_table(spark.createDataFrame([*upto.items()], READ_UP_TO).coalesce(1), f"{version}/upto")
    versions.commit(version)
    folder = Folder(spark, f"{root}/{CHANGES}")
    for writer, batch in _batches(spark, root):
        if batch <= before.get(writer, -1):
            folder.delete(f"{WRITER}={writer}/{BATCH}={batch}")
    return version


def followed_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that follow now."""
    return followed_edges(spark, root).select("follower", "followee")
