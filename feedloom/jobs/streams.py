"""What the streaming jobs share: a session, and how long a stream runs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def parser(description: str) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=description)
    out.add_argument("--once", action="store_true", help="take what is there, then end")
    out.add_argument("--trigger", default="1 minute", help="time between batches")
    return out


def session(name: str) -> SparkSession:
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def trigger(args: argparse.Namespace) -> dict:
    return {"availableNow": True} if args.once else {"processingTime": args.trigger}


def wait(stream: StreamingQuery) -> None:
    stream.awaitTermination()
