"""Scans of stored tables; filters and columns reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedloom.sinks.tables import BATCH, WRITER


def read_table(
    spark: SparkSession,
    path: str,
    where: Column | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if where is None else df.where(where)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a table of batches, whoever wrote them. The schema makes an empty table readable."""
    labelled = StructType([*schema, StructField(WRITER, StringType()), StructField(BATCH, LongType())])
    return spark.read.schema(labelled).parquet(path).drop(WRITER, BATCH)


def find_user(table: DataFrame, username: str) -> DataFrame:
    """The row of one username, or no row."""
    return table.where(F.col("username") == username).limit(1)


def find_users(table: DataFrame, usernames: DataFrame) -> DataFrame:
    """The rows of many usernames."""
    return table.join(usernames.select("username").distinct(), "username", "left_semi")


def table_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    files: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A table folder as a stream of its files; `files` is a name pattern."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
