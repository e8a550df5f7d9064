"""spark-submit -m style job: python -m feedloom.jobs.bulk_load USERS TWEETS OUT"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from feedloom.plans.bulk_load import bulk_load


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Load JSON-lines users and tweets.")
    parser.add_argument("users", help="path or folder of user lines")
    parser.add_argument("tweets", help="path or folder of tweet lines")
    parser.add_argument("out", help="folder of the feed tables; their contents are replaced")
    args = parser.parse_args(argv)
    spark = (
        SparkSession.builder.appName("feed-bulk-load")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    loaded_at = datetime.now(timezone.utc).replace(tzinfo=None)
    print(bulk_load(spark, args.users, args.tweets, args.out, loaded_at).root)


if __name__ == "__main__":
    main()
