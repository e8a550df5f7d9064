"""Counts per key over sliding event-time windows, in three forms with equal results.

A row at time t counts in every window [end - length, end) that holds t; ends lie
on the grid of `slide`, aligned to the epoch plus `offset`. All arithmetic is on timestamps and
day-time intervals, so TIMESTAMP and TIMESTAMP_NTZ columns both work.

expand   one shuffle; each row is copied into length/slide windows before counting.
chained  rows -> counts per slot -> windows; copies slot counts instead of rows.
delta    slot counts become +n / -n change points, summed in time order per key and
         chunk of time; copies nothing into the shuffle, fills windows afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SlidingWindow:
    """Window length, slide and offset of the grid, in whole seconds."""

    length: timedelta = timedelta(minutes=10)
    slide: timedelta = timedelta(minutes=1)
    offset: timedelta = timedelta(0)

    def __post_init__(self) -> None:
        if any(part.microseconds for part in (self.length, self.slide, self.offset)):
            raise ValueError("length, slide and offset must be whole seconds")
        if min(self.length, self.slide) <= timedelta(0):
            raise ValueError("length and slide must be positive")
        if self.slide > self.length:
            raise ValueError("slide must not exceed length")

    @property
    def length_seconds(self) -> int:
        return int(self.length.total_seconds())

    @property
    def slide_seconds(self) -> int:
        return int(self.slide.total_seconds())

    @property
    def slot_seconds(self) -> int:
        """Widest slot that no window edge cuts."""
        return gcd(self.length_seconds, self.slide_seconds)

    @property
    def start_time(self) -> str:
        return duration(int(self.offset.total_seconds()) % self.slide_seconds)

    def sliding(self, ts: str | Column) -> Column:
        # Ends are on the grid also where the slide doesn't divide the length.
        start = int(self.offset.total_seconds()) - self.length_seconds
        return F.window(
            ts,
            duration(self.length_seconds),
            duration(self.slide_seconds),
            duration(start % self.slide_seconds),
        )

    def slot(self, ts: str | Column) -> Column:
        offset = int(self.offset.total_seconds()) % self.slot_seconds
        return F.window(ts, duration(self.slot_seconds), startTime=duration(offset))


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def duration(n: int) -> str:
    return f"{n} seconds"


def expand_counts(df: DataFrame, ts: str, key: str, spec: SlidingWindow) -> DataFrame:
    return (
        df.groupBy(spec.sliding(ts).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("w.end").alias("window_end"), key, "cnt")
    )


def slot_counts(df: DataFrame, ts: str, key: str, spec: SlidingWindow) -> DataFrame:
    """Counts per key and tumbling slot: `slot`, key, `n`."""
    return df.groupBy(spec.slot(ts).alias("slot"), key).agg(F.count(F.lit(1)).alias("n"))


def chained_counts(df: DataFrame, ts: str, key: str, spec: SlidingWindow) -> DataFrame:
    """Also valid on a streaming frame with a watermark on `ts`."""
    return (
        slot_counts(df, ts, key, spec)
        .groupBy(spec.sliding(F.window_time("slot")).alias("w"), key)
        .agg(F.sum("n").alias("cnt"))
        .select(F.col("w.end").alias("window_end"), key, "cnt")
    )


def delta_counts(
    df: DataFrame,
    ts: str,
    key: str,
    spec: SlidingWindow,
    chunk: timedelta = timedelta(days=1),
) -> DataFrame:
    """Each (key, chunk of time) is summed on its own, so a hot key splits by time
    and a group has at most two points per slot of one chunk."""
    if spec.length_seconds % spec.slide_seconds:
        raise ValueError("delta form needs a length that is a multiple of the slide")
    chunk_seconds = max(int(chunk.total_seconds()), 2 * spec.length_seconds)
    chunk_seconds -= chunk_seconds % spec.slide_seconds
    slide = seconds(spec.slide_seconds)
    # A slot counts in the windows that end from slot_end up to slot_end + length - slide.
    last_end = F.col("slot_end") + seconds(spec.length_seconds - spec.slide_seconds)

    def chunk_start(end: Column) -> Column:
        return F.window(end, duration(chunk_seconds), startTime=spec.start_time)["start"]

    points = (
        slot_counts(df, ts, key, spec)
        .select(F.col("slot.end").alias("slot_end"), key, "n")
        .withColumn("_first", chunk_start(F.col("slot_end")))
        .withColumn("_last", chunk_start(last_end))
        .withColumn(
            "chunk",
            F.explode(
                F.when(F.col("_first") == F.col("_last"), F.array("_first")).otherwise(
                    F.array("_first", "_last")
                )
            ),
        )
        .withColumn("chunk_end", F.col("chunk") + seconds(chunk_seconds))
        .withColumn(
            "point",
            F.explode(
                F.array(
                    F.struct(
                        F.greatest("slot_end", "chunk").alias("at"),
                        F.col("n").alias("change"),
                    ),
                    F.struct(
                        F.least(
                            F.col("slot_end") + seconds(spec.length_seconds), "chunk_end"
                        ).alias("at"),
                        (-F.col("n")).alias("change"),
                    ),
                )
            ),
        )
        .select(key, "chunk", "point.at", "point.change")
    )
    in_time = Window.partitionBy(key, "chunk").orderBy("at")
    until = F.lead("at").over(in_time)
    return (
        points.withColumns(
            {
                # RANGE frame: points at the same time are summed together.
                "cnt": F.sum("change").over(
                    in_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                "until": until,
            }
        )
        .where((F.col("cnt") > 0) & (F.col("until") > F.col("at")))
        .withColumn("window_end", F.explode(F.sequence("at", F.col("until") - slide, slide)))
        .select("window_end", key, "cnt")
    )


FORMS = {"expand": expand_counts, "chained": chained_counts, "delta": delta_counts}


def sliding_counts(
    df: DataFrame,
    ts: str,
    key: str,
    spec: SlidingWindow = SlidingWindow(),
    form: str | None = None,
) -> DataFrame:
    """`window_end`, key, `cnt` for every window in which the key occurs.

    Without a `form`: delta, or chained where the slide doesn't divide the length.
    """
    if form is None:
        form = "chained" if spec.length_seconds % spec.slide_seconds else "delta"
    return FORMS[form](df, ts, key, spec)
