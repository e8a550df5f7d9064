"""Topic sink for new tweets. Needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.sources.topic import TOPIC


def topic_records(
    tweets: DataFrame, as_json: bool = False, partition: int | None = None
) -> DataFrame:
    """`value[, partition]`: the bare text, or JSON with the time of the post.

    Leave `partition` open to spread the topic; 0 puts all messages in one partition.
    """
    value = F.to_json(F.struct("created_at", "text")) if as_json else F.col("text")
    records = tweets.select(value.alias("value"))
    return records if partition is None else records.withColumn("partition", F.lit(partition))


def publish(records: DataFrame, servers: str, topic: str = TOPIC) -> None:
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
