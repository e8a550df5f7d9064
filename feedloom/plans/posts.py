"""New tweets: rules, author name, records for table and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import text_problem
from feedloom.functions.times import utc_wall_clock
from feedloom.plans.timelines import with_author_names


def check_texts(posts: DataFrame) -> DataFrame:
    """Adds `problem`: "empty", "too_long" or NULL."""
    return posts.withColumn("problem", text_problem(F.col("text")))


def tweet_records(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts as stored tweets; a post without a time gets the current one."""
    return with_author_names(posts, users).select(
        "tweet_id",
        F.coalesce(
            "created_at", utc_wall_clock(F.current_timestamp())
        ).alias("created_at"),
        "text",
        "username",
        "name",
    )
