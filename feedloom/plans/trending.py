"""Trending hashtags over a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import REPORT_HEADER, is_hashtag, ranking_line, words
from feedloom.operators.sliding import SlidingWindow, sliding_counts
from feedloom.operators.topk import top_k, top_k_per_group


def tag_order() -> list:
    """Most frequent first; equal counts by tag."""
    return [F.desc("cnt"), F.asc("tag")]


def hashtag_tokens(tweets: DataFrame) -> DataFrame:
    """`tweet_id, pos, tag`: every tag of every tweet with its place among the words."""
    return (
        tweets.select("tweet_id", F.posexplode(words(F.col("text"))).alias("pos", "tag"))
        .where(is_hashtag(F.col("tag")))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


def timed_tags(tweets: DataFrame, ts: str = "created_at") -> DataFrame:
    return tweets.select(F.col(ts).alias("ts"), F.explode(words(F.col("text"))).alias("tag")).where(
        is_hashtag(F.col("tag"))
    )


def hashtag_totals(tweets: DataFrame) -> DataFrame:
    return (
        tweets.select(F.explode(words(F.col("text"))).alias("tag"))
        .where(is_hashtag(F.col("tag")))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def hashtag_top(tweets: DataFrame, k: int = 10) -> DataFrame:
    return top_k(hashtag_totals(tweets), tag_order(), k)


def hashtag_window_counts(
    tweets: DataFrame, spec: SlidingWindow = SlidingWindow(), form: str | None = None
) -> DataFrame:
    return sliding_counts(timed_tags(tweets), "ts", "tag", spec, form)


def trending(
    tweets: DataFrame,
    spec: SlidingWindow = SlidingWindow(),
    k: int = 10,
    form: str | None = None,
) -> DataFrame:
    """`window_end, rk, tag, cnt`: the k most frequent tags of every window."""
    counts = hashtag_window_counts(tweets, spec, form)
    return top_k_per_group(counts, ["window_end"], tag_order(), k).select(
        "window_end", "rk", "tag", "cnt"
    )


def report_text(ranking: DataFrame) -> DataFrame:
    """`window_end, report`: the ranking of each window as the printed text."""
    line = F.struct("rk", ranking_line(F.col("cnt"), F.col("tag")).alias("line"))
    lines = F.array_sort(F.collect_list(line))["line"]
    return ranking.groupBy("window_end").agg(
        F.concat(F.lit(REPORT_HEADER), F.array_join(lines, "")).alias("report")
    )
