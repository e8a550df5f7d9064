"""Profile and home timelines: newest tweets per author, per viewer, or of one user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.times import display_time
from feedloom.operators.skew import hot_keys, salted_join
from feedloom.operators.topk import top_k, top_k_per_group


def newest_first() -> list:
    return [F.desc("created_at"), F.desc("tweet_id")]


def with_author_names(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Every tweet with the `name` of its author (NULL when unknown).

    The tweets are read once; adaptive execution splits those of a very busy author.
    """
    return tweets.join(users.select("username", "name"), "username", "left")


def newest_per_author(tweets: DataFrame, k: int = 10) -> DataFrame:
    return top_k_per_group(tweets, ["username"], newest_first(), k)


def profile_timelines(tweets: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Per author the k newest tweets with display time and page title.

    The cut comes first, so the join sees at most k rows per author.
    """
    return (
        newest_per_author(tweets.select("tweet_id", "username", "created_at", "text"), k)
        .join(users.select("username", "name"), "username", "left")
        .withColumns(
            {
                "display_time": display_time(F.col("created_at")),
                "title": F.concat("name", F.lit("'s Profile:")),
            }
        )
    )


def profile_timeline(tweets: DataFrame, username: str, k: int = 10) -> DataFrame:
    """The k newest tweets of one author."""
    own = tweets.where(F.col("username") == username)
    return top_k(own, newest_first(), k).withColumn(
        "display_time", display_time(F.col("created_at"))
    )


def followees_of(edges: DataFrame, viewer: str) -> DataFrame:
    return edges.where(F.col("follower") == viewer).select(
        F.col("followee").alias("username")
    )


def followee_tweets(tweets: DataFrame, edges: DataFrame, viewer: str) -> DataFrame:
    """All tweets of the users that `viewer` follows; a repeated edge repeats nothing.

    Spark broadcasts a list that its statistics show to be short; otherwise adaptive
    execution splits the tweets of a busy author.
    """
    return tweets.join(followees_of(edges, viewer).distinct(), "username", "left_semi")


def home_timeline(
    tweets: DataFrame,
    edges: DataFrame,
    viewer: str,
    k: int = 10,
) -> DataFrame:
    """The k newest tweets of the users that `viewer` follows.

    Each task of the join keeps its own k newest.
    """
    seen = followee_tweets(tweets, edges, viewer)
    return top_k(seen, newest_first(), k).withColumn(
        "display_time", display_time(F.col("created_at"))
    )


def home_timelines(
    tweets: DataFrame,
    edges: DataFrame,
    k: int = 10,
    min_hot_rows: int | None = None,
) -> DataFrame:
    """Per viewer the k newest tweets of all followees.

    No viewer can see more than the k newest of one author, so authors are cut
    before the join, which yields at most k rows per edge. Only ids and times go
    through it and the ranking; texts are joined to the k rows per viewer that stay.

    Adaptive execution splits the followers of a popular author in both joins. Where it is off, give
    `min_hot_rows`: authors of as many followers are spread by salt, which reads the edges once more.
    """
    candidates = newest_per_author(
        tweets.select("tweet_id", "username", "created_at", "text"), k
    )
    pairs = edges.select(F.col("follower").alias("viewer"), "followee")
    # A viewer has one row per tweet at most, so the authors that are hot in one join are those of the other.
    hot = None if min_hot_rows is None else hot_keys(pairs, ["followee"], min_rows=min_hot_rows)

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        if hot is None:
            return left.join(right, keys)
        return salted_join(left, right, keys, "inner", ["viewer"], hot, min_hot_rows)

    of_followees = candidates.withColumnRenamed("username", "followee")
    seen = joined(pairs, of_followees.select("followee", "tweet_id", "created_at"), ["followee"])
    shown = top_k_per_group(
        seen, ["viewer"], [*newest_first(), F.asc("followee")], k
    )
    # Two authors may have used one tweet_id.
    texts = of_followees.select("followee", "tweet_id", "text")
    return (
        joined(shown, texts, ["followee", "tweet_id"])
        .withColumnRenamed("followee", "username")
        .withColumn("display_time", display_time(F.col("created_at")))
    )


def home_titles(users: DataFrame) -> DataFrame:
    """Page title per viewer."""
    return users.select("username", F.concat("name", F.lit("'s Timeline:")).alias("title"))
