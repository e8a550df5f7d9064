"""Top-k, globally and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    """First k rows of the whole frame (plans as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int = 10,
    rank: str = "rk",
) -> DataFrame:
    """First k rows per group with their rank.

    The rank filter plans as WindowGroupLimit, so each task sends at most k rows of
    a group to the shuffle and a hot group never meets in one task. That holds for k up to
    spark.sql.optimizer.windowGroupLimitThreshold (1,000); set it higher for a larger k.
    """
    spec = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(spec))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )
