"""New tweets from a folder of posts to the tweets table of a feed, and to the topic.

python -m feedloom.jobs.ingest POSTS FEED CHECKPOINT [--rejects PATH] [--servers host:9092]

The tweets go to the current version of the feed. A load makes a new version: stop the job before it, and start it with
the same checkpoint afterwards.
"""

from __future__ import annotations

from feedloom.jobs import streams
from feedloom.plans.bulk_load import feed_tables
from feedloom.schemas import POSTS
from feedloom.sources.tables import table_stream
from feedloom.sources.topic import TOPIC
from feedloom.streaming.posts import post_stream, to_topic


def main(argv: list[str] | None = None) -> None:
    parser = streams.parser("Write new tweets to the feed.")
    parser.add_argument("posts", help="Parquet folder with tweet_id, created_at, text, username")
    parser.add_argument("feed", help="folder that bulk_load has filled")
    parser.add_argument("checkpoint")
    parser.add_argument("--rejects", help="folder for texts that can't be posted; else all are")
    parser.add_argument("--servers", help="Kafka bootstrap servers; else nothing is sent")
    parser.add_argument("--topic", default=TOPIC)
    parser.add_argument("--json", action="store_true", help="messages carry created_at")
    args = parser.parse_args(argv)
    spark = streams.session("feed-ingest")
    feed = feed_tables(spark, args.feed)
    streams.wait(
        post_stream(
            table_stream(spark, args.posts, POSTS),
            lambda session: session.read.parquet(feed.path("users")),
            feed.path("tweets"),
            args.checkpoint,
            send=to_topic(args.servers, args.topic) if args.servers else None,
            rejects=args.rejects,
            as_json=args.json,
            trigger=streams.trigger(args),
        )
    )


if __name__ == "__main__":
    main()
