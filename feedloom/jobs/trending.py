"""Trending job over a topic or a tweets table.

python -m feedloom.jobs.trending OUT --servers host:9092    (stream, runs until stopped)
python -m feedloom.jobs.trending OUT --tweets /path/tweets  (bounded table)
"""

from __future__ import annotations

import argparse
from datetime import timedelta

from pyspark.sql import SparkSession

from feedloom.operators.sliding import SlidingWindow
from feedloom.plans.expired import trending_keep_expired
from feedloom.plans.trending import report_text, trending
from feedloom.sinks.tables import replace_table
from feedloom.sources.topic import TOPIC, message_posts, message_texts, topic_stream
from feedloom.streaming.trending import trending_stream, use_rocksdb


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Top hashtags per sliding window.")
    parser.add_argument("out", help="folder for the tables `trending` and `reports`")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--servers", help="Kafka bootstrap servers")
    source.add_argument("--tweets", help="Parquet table with created_at and text")
    parser.add_argument("--topic", default=TOPIC)
    parser.add_argument("--json", action="store_true", help="messages carry created_at")
    parser.add_argument("--window", type=int, default=600, help="seconds")
    parser.add_argument("--slide", type=int, default=60, help="seconds")
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("--delay", default="1 minute", help="how late messages may be")
    parser.add_argument("--trigger", default="1 second")
    parser.add_argument("--keep-expired", action="store_true", help="tables only")
    args = parser.parse_args(argv)
    if args.keep_expired and args.servers:
        parser.error("--keep-expired needs --tweets")
    spark = (
        SparkSession.builder.appName("feed-trending")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spec = SlidingWindow(timedelta(seconds=args.window), timedelta(seconds=args.slide))
    if args.tweets:
        # Files of a plain table or folders of batches: the columns are the same.
        tweets = spark.read.parquet(args.tweets)
        plan = trending_keep_expired if args.keep_expired else trending
        replace_table(plan(tweets, spec, args.top), f"{args.out}/trending")
        ranking = spark.read.parquet(f"{args.out}/trending")
        replace_table(report_text(ranking), f"{args.out}/reports")
        return
    use_rocksdb(spark)
    messages = topic_stream(spark, args.servers, args.topic)
    trending_stream(
        message_posts(messages) if args.json else message_texts(messages),
        f"{args.out}/trending",
        f"{args.out}/checkpoint",
        spec,
        args.top,
        args.delay,
        {"processingTime": args.trigger},
        reports=f"{args.out}/reports",
    ).awaitTermination()


if __name__ == "__main__":
    main()
