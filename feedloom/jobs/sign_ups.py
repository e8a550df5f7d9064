"""New accounts from a folder of sign-up requests.

python -m feedloom.jobs.sign_ups REQUESTS FEED OUT [--once]

Accounts and outcomes go below OUT; the accounts of the feed keep their names.
"""

from __future__ import annotations

from feedloom.jobs import streams
from feedloom.plans.bulk_load import feed_tables
from feedloom.schemas import SIGN_UPS
from feedloom.sources.tables import table_stream
from feedloom.streaming.sign_ups import sign_up_stream


def main(argv: list[str] | None = None) -> None:
    parser = streams.parser("Decide sign-up requests.")
    parser.add_argument("requests", help="Parquet folder with request_id, username, name")
    parser.add_argument("feed", help="folder that bulk_load has filled")
    parser.add_argument("out")
    args = parser.parse_args(argv)
    spark = streams.session("feed-sign-ups")
    streams.wait(
        sign_up_stream(
            table_stream(spark, args.requests, SIGN_UPS),
            # Asked for once a batch, so a load that comes meanwhile is seen.
            lambda session: session.read.parquet(feed_tables(session, args.feed).path("users")),
            args.out,
            f"{args.out}/checkpoint",
            streams.trigger(args),
        )
    )


if __name__ == "__main__":
    main()
