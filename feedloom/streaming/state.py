"""What a trending stream holds in its state, read from its checkpoint while it is stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_of(spark: SparkSession, checkpoint: str, operator: int) -> DataFrame:
    """Keys and values of one stateful operator, as of the last complete batch."""
    stored = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return stored.select("key.*", "value.*")


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """`level, end, tag, cnt`: counts of slots that are still open ("slot"), and sums of closed slots for windows that
    are ("window")."""
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct().collect()
    out = None
    for row in operators:
        state = state_of(spark, checkpoint, row.operatorId)
        level, value = ("slot", "count") if "count" in state.columns else ("window", "sum")
        counts = state.select(
            F.lit(level).alias("level"), F.col("window.end").alias("end"), "tag", F.col(value).alias("cnt")
        )
        out = counts if out is None else out.unionByName(counts)
    return out
