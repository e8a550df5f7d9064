"""Tweet messages from a Kafka topic. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the topic the feed posts to.
TOPIC = "tweets"


def topic_stream(
    spark: SparkSession, servers: str, topic: str = TOPIC, starting: str = "latest"
) -> DataFrame:
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )


def message_texts(messages: DataFrame) -> DataFrame:
    """`ts, text` of messages that hold the bare text; ts is the message's own time."""
    return messages.select(
        F.col("timestamp").alias("ts"), F.col("value").cast("string").alias("text")
    )


def message_posts(messages: DataFrame) -> DataFrame:
    """`ts, text` of messages written with `as_json`; ts is the time of the post."""
    post = F.from_json(F.col("value").cast("string"), "created_at TIMESTAMP, text STRING")
    return messages.select(post.alias("post")).select(
        F.col("post.created_at").alias("ts"), F.col("post.text").alias("text")
    )
