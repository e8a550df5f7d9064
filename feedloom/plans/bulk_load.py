"""Bulk load: two JSON-lines inputs to the four feed tables and the rejects."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.times import parse_created_at, utc_wall_clock, wall_clock
from feedloom.operators.accounts import first_per_key, with_credentials
from feedloom.schemas import CORRUPT, TWEET_LINE, USER_LINE
from feedloom.sinks.tables import LOAD, replace_table, write_batch
from feedloom.sinks.versions import Folder, Versions
from feedloom.sources.lines import LINE_ORDER, read_tweet_lines, read_user_lines

MALFORMED, NO_USERNAME = "malformed", "no_username"
FIRST_LOADED_ID = -(1 << 62)
DUPLICATE, BAD_DATE = "duplicate_username", "bad_created_at"


@dataclass(frozen=True)
class FeedTables:
    """Paths of the tables below one folder."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def line_order() -> list:
    return [F.col(c) for c in LINE_ORDER]


def line_problem(df: DataFrame) -> DataFrame:
    """Adds `reason`: why a line cannot be loaded, NULL when it can."""
    return df.withColumn(
        "reason",
        F.when(F.col(CORRUPT).isNotNull(), MALFORMED).when(
            F.col("username").isNull(), NO_USERNAME
        ),
    )


def reject_rows(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    raw = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*fields)))
    return df.select(F.lit(source).alias("input"), "reason", raw.alias("line"))


def first_rows(lines: DataFrame) -> DataFrame:
    """`row` of the first usable line of each username; reads only names and places."""
    usable = line_problem(lines).where(F.col("reason").isNull())
    return first_per_key(usable.select("username", *LINE_ORDER), "username", line_order()).select("row")


def split_users(lines: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first line of each username, rejects). Both inputs must be written tables.

    Lines are told apart by their row number, which is unique, so a username that fills
    a large share of the input is spread like all other lines.
    """
    marked = line_problem(lines)
    usable = marked.where(F.col("reason").isNull())
    repeats = usable.join(first, "row", "left_anti").withColumn("reason", F.lit(DUPLICATE))
    rejects = marked.where(F.col("reason").isNotNull()).unionByName(repeats.select(marked.columns))
    kept = usable.join(first, "row", "left_semi").drop("reason", CORRUPT)
    return kept, reject_rows(rejects, "users", USER_LINE.names)


def split_tweets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tweets, rejects) of lines with their parsed time `at`. Ids follow the lines and are negative, so that
    they never meet those of posts."""
    marked = line_problem(lines).withColumn(
        "reason",
        F.coalesce(F.col("reason"), F.when(F.col("at").isNull(), F.lit(BAD_DATE))),
    )
    tweets = marked.where(F.col("reason").isNull()).select(
        (F.col("row") + FIRST_LOADED_ID).alias("tweet_id"),
        F.col("at").alias("created_at"),
        "text",
        "username",
        F.lit(None).cast("string").alias("name"),
    )
    rejects = marked.where(F.col("reason").isNotNull())
    return tweets, reject_rows(rejects, "tweets", TWEET_LINE.names)


def feed_tables(spark: SparkSession, out_dir: str) -> FeedTables:
    """The tables of the last complete load into `out_dir`."""
    current = Versions(spark, out_dir).current()
    if current is None:
        raise FileNotFoundError(f"nothing was loaded into {out_dir}")
    return FeedTables(current)


def bulk_load(
    spark: SparkSession,
    users_path: str,
    tweets_path: str,
    out_dir: str,
    loaded_at: datetime,
) -> FeedTables:
    """Replaces users, following, followers, tweets and rejects in `out_dir`, all at once.

    The tables are written to a new version, which becomes the current one when all are complete; a load
    that fails leaves the old tables as they are. `feed_tables` finds the current ones. The version before stays
    until the next load, for jobs that are reading it.

    Each input is parsed once into a staged table, which is deleted in the end. That fixes the line order
    for all later jobs, and each of them reads only its own columns. The tweets table is one of
    batches, to which posts are added later; read it with `sources.tables.read_batches`.
    """
    versions = Versions(spark, out_dir)
    tables = FeedTables(versions.begin())
    staging = FeedTables(tables.path("staging"))
    try:
        replace_table(read_user_lines(spark, users_path), staging.path("users"))
        at = utc_wall_clock(parse_created_at(F.col("created_at")))
        replace_table(read_tweet_lines(spark, tweets_path).withColumn("at", at), staging.path("tweets"))
        lines = spark.read.parquet(staging.path("users"))
        replace_table(first_rows(lines), staging.path("first"))

        users, user_rejects = split_users(lines, spark.read.parquet(staging.path("first")))
        tweets, tweet_rejects = split_tweets(spark.read.parquet(staging.path("tweets")))

        accounts = with_credentials(users.select("username", "name"), wall_clock(loaded_at))
        replace_table(accounts, tables.path("users"))
        replace_table(users.select("username", "following"), tables.path("following"))
        replace_table(users.select("username", "followers"), tables.path("followers"))
        write_batch(tweets, tables.path("tweets"), 0, LOAD)
        replace_table(user_rejects.unionByName(tweet_rejects), tables.path("rejects"))
    finally:
        Folder(spark, tables.root).delete("staging")
    versions.commit(tables.root)
    return tables
