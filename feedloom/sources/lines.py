"""JSON-lines inputs of the bulk load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.schemas import CORRUPT, TWEET_LINE, USER_LINE

# Columns that give the order of lines: file, then split, then row of the split.
LINE_ORDER = ["file", "split", "row"]


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row per non-blank line, with its place; malformed ones fill `_corrupt`.

    `row` numbers the rows of one scan, so write the frame to a table before two
    jobs have to agree on it.
    """
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def read_user_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, USER_LINE)


def read_tweet_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, TWEET_LINE)
