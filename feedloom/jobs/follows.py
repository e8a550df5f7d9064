"""Who follows whom, from a folder of follow events: the stream, its compaction, and the lists.

python -m feedloom.jobs.follows EVENTS OUT [--once]      (stream, runs until stopped)
python -m feedloom.jobs.follows OUT --compact            (merges the batches into a snapshot)
python -m feedloom.jobs.follows OUT --lists LISTS        (following and followers lists as of now)
"""

from __future__ import annotations

from feedloom.jobs import streams
from feedloom.operators.follows import follow_lists
from feedloom.schemas import FOLLOW_EVENTS
from feedloom.sinks.tables import replace_table
from feedloom.sources.tables import table_stream
from feedloom.streaming.follows import compact, follow_stream, followed_edges


def main(argv: list[str] | None = None) -> None:
    parser = streams.parser("Keep the follow graph up to date.")
    parser.add_argument("paths", nargs="+", help="[folder of follow events] and the job's folder")
    parser.add_argument("--compact", action="store_true")
    parser.add_argument("--lists", help="folder for the tables edges, following and followers")
    args = parser.parse_args(argv)
    if len(args.paths) != (1 if args.compact or args.lists else 2):
        parser.error("EVENTS and OUT for the stream, else OUT alone")
    spark, out = streams.session("feed-follows"), args.paths[-1]
    if args.compact:
        compact(spark, out)
    if args.lists:
        replace_table(followed_edges(spark, out), f"{args.lists}/edges")
        edges = spark.read.parquet(f"{args.lists}/edges")
        for side in ("following", "followers"):
            replace_table(follow_lists(edges, side), f"{args.lists}/{side}")
    if len(args.paths) == 2:
        events = table_stream(spark, args.paths[0], FOLLOW_EVENTS)
        streams.wait(follow_stream(events, out, f"{out}/checkpoint", streams.trigger(args)))


if __name__ == "__main__":
    main()
