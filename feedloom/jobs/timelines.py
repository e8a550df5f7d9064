"""Edges, lists and timelines of all users from the feed tables.

The feed stores each relation twice, as following and as followers, and the two need not agree:
each is carried on by itself, and `asymmetry` lists the pairs that only one of them holds.

python -m feedloom.jobs.timelines FEED OUT [--events /path/follow_events]
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from feedloom.operators.follows import (
    apply_follow_events,
    edges_of_lists,
    follow_lists,
    mark_unknown,
    one_sided_edges,
)
from feedloom.plans.bulk_load import feed_tables
from feedloom.plans.timelines import home_timelines, profile_timelines
from feedloom.schemas import TWEETS
from feedloom.sinks.tables import replace_table
from feedloom.sources.tables import read_batches

# Loaded lists carry no time; they come before every event.
BEFORE_EVENTS = datetime(1970, 1, 1)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Build the pages of all users.")
    parser.add_argument("feed", help="folder that bulk_load has filled")
    parser.add_argument("out")
    parser.add_argument("--events", help="follow events since the load")
    parser.add_argument("--top", type=int, default=10)
    args = parser.parse_args(argv)
    spark = (
        SparkSession.builder.appName("feed-timelines")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    feed = feed_tables(spark, args.feed)
    users = spark.read.parquet(feed.path("users"))
    tweets = read_batches(spark, feed.path("tweets"), TWEETS).drop("name")
    sides = {
        side: edges_of_lists(spark.read.parquet(feed.path(side)), side, BEFORE_EVENTS)
        for side in ("following", "followers")
    }
    if args.events:
        marked = mark_unknown(spark.read.parquet(args.events), users)
        replace_table(marked, f"{args.out}/follow_events")
        marked = spark.read.parquet(f"{args.out}/follow_events")
        known = F.col("follower_known") & F.col("followee_known")
        replace_table(marked.where(~known), f"{args.out}/rejects")
        sides = {
            side: apply_follow_events(edges, marked.where(known)) for side, edges in sides.items()
        }
    for side, edges in sides.items():
        replace_table(edges, f"{args.out}/{side}_edges")
        sides[side] = spark.read.parquet(f"{args.out}/{side}_edges")
        replace_table(follow_lists(sides[side], side), f"{args.out}/{side}")
    edges = sides["following"]
    replace_table(one_sided_edges(edges, sides["followers"]), f"{args.out}/asymmetry")
    replace_table(profile_timelines(tweets, users, args.top), f"{args.out}/profiles")
    replace_table(home_timelines(tweets, edges, args.top), f"{args.out}/homes")


if __name__ == "__main__":
    main()
