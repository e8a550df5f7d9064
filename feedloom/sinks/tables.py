"""Table sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import ROWS_PER_SALT, hot_keys
from feedloom.sinks.versions import Folder


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Adds files to a plain table. Tables of batches take `append_batch` instead: files without
    labels would hide theirs."""
    folder = Folder(df.sparkSession, path)
    if any(name.startswith(f"{WRITER}=") for name in folder.names()):
        raise ValueError(f"{path} is a table of batches")
    df.write.mode("append").parquet(path)


# Tables with several writers hold one folder per writer and batch; see sources.read_batches.
WRITER, BATCH = "batch_writer", "batch_id"
LOAD = "load"


def write_batch(df: DataFrame, path: str, batch_id: int, writer: str) -> str:
    """Writes one batch of one writer to its own folder; writing it again replaces it.

    Batch ids start anew with each checkpoint, so a stream's `writer` is its own id.
    """
    folder = f"{path}/{WRITER}={writer}/{BATCH}={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def replace_batches(df: DataFrame, path: str) -> None:
    """Replaces all batches of all writers by `df`; streams may add to it later."""
    labels = {WRITER: F.lit(LOAD), BATCH: F.lit(0).cast("bigint")}
    df.withColumns(labels).write.mode("overwrite").partitionBy(WRITER, BATCH).parquet(path)


def append_batch(df: DataFrame, path: str) -> str:
    """Adds `df` as a batch of a new writer."""
    return write_batch(df, path, 0, f"append-{uuid.uuid4().hex}")


def write_indexed(
    df: DataFrame, path: str, column: str = "username", names: int | None = None, row_group_bytes: int = 16 << 20
) -> None:
    """Table for lookups by `column`: sorted into ranges of it, in small row groups with a Bloom filter each.

    A filter on the column skips all files and row groups whose bounds or Bloom filter rule the value
    out. `names` is how many different values a row group may have, if known.
    """
    writer = (
        df.repartitionByRange(column)
        .sortWithinPartitions(column)
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .option(f"parquet.bloom.filter.enabled#{column}", "true")
    )
    if names is not None:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", names)
    writer.parquet(path)


def write_bucketed(
    df: DataFrame,
    name: str,
    buckets: int,
    column: str = "username",
    path: str | None = None,
    spread_by: Sequence[str] = (),
    rows_per_file: int = ROWS_PER_SALT,
) -> None:
    """Catalog table laid out by `column`: joins on it need no shuffle, lookups read
    one bucket.

    Where a value of `column` may hold a large share of the rows, name in `spread_by`
    columns that tell its rows apart: many tasks then write its bucket.
    """
    if spread_by:
        hot = F.broadcast(hot_keys(df, [column], min_rows=rows_per_file))
        files = F.ceil(F.col("_n") / rows_per_file).cast("bigint")
        busy = (
            df.join(hot, column)
            .withColumn("_part", F.pmod(F.xxhash64(*spread_by), files))
            .repartition(column, "_part")
        )
        # One task and one file per bucket, except for the busy keys.
        rest = df.join(hot, column, "left_anti").repartition(buckets, column)
        laid_out = rest.select(df.columns).unionByName(busy.select(df.columns))
    else:
        laid_out = df.repartition(buckets, column)
    writer = laid_out.write.mode("overwrite").bucketBy(buckets, column).sortBy(column)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
