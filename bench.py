"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores. Each query runs twice to its last row; the faster counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from feedloom.session import local_session

HEADLINE = [
    "hashtag_totals",
    "hashtag_global_top10",
    "trending_top10",
    "trending_expand",
    "trending_keep_expired",
    "trending_report_text",
    "follow_edges",
    "following_lists",
    "is_following",
    "profile_timeline",
    "home_timeline",
    "tweets_with_names",
    "credential_outcomes",
    "bulk_load_users",
    "stream_trending",
    "stream_follow_state",
    "stream_post_ingest",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {n: round(min(timed(spark, n, sf_dir) for _ in range(2)), 3) for n in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "feed_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
