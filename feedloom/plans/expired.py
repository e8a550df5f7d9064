"""Trending with tags kept at count 0 after their last occurrence left the window.

Such tags show only where a window has fewer than k live ones. The ones that fill a
window of m live tags are among the k smallest tags seen by then, so no zero rows of
all tags are built: the k smallest new tags of a slot are enough, and a scan over blocks of slots gives
what was seen before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from feedloom.operators.running import smallest_until
from feedloom.operators.sliding import SlidingWindow, duration, seconds
from feedloom.operators.topk import top_k_per_group
from feedloom.plans.trending import tag_order, timed_tags, trending
from feedloom.session import run_dir


def first_end(ts: str | Column, spec: SlidingWindow) -> Column:
    """End of the first window that holds `ts`; ends lie on the grid of the slide."""
    return F.window(ts, duration(spec.slide_seconds), startTime=spec.start_time)["end"]


def first_ends(tweets: DataFrame, spec: SlidingWindow, k: int) -> DataFrame:
    """`end, tag`: the k smallest tags that first occur in each slot."""
    first = (
        timed_tags(tweets)
        .groupBy("tag")
        .agg(F.min(first_end("ts", spec)).alias("end"))
    )
    return top_k_per_group(first, ["end"], [F.asc("tag")], k).select("end", "tag")


def window_ends(tweets: DataFrame, spec: SlidingWindow) -> Row | None:
    """`lo, places`: the end of the first window with a live tag, as text, and how many windows there are up to the
    last one; None without tags."""
    bounds = (
        timed_tags(tweets)
        .agg(F.min("ts").alias("lo_ts"), (F.max("ts") + seconds(spec.length_seconds)).alias("hi_ts"))
        .where("lo_ts IS NOT NULL")
        .withColumn("lo", first_end("lo_ts", spec))
        # The last end that isn't behind the reach of the last tag.
        .withColumn("hi", first_end("hi_ts", spec) - seconds(spec.slide_seconds))
    )
    return bounds.select(F.col("lo").cast("string").alias("lo"), (steps(F.col("hi") - F.col("lo"), spec) + 1).alias("places")).first()


def steps(passed: Column, spec: SlidingWindow) -> Column:
    """How many slides an interval has."""
    return F.floor(passed.cast("interval second").cast("bigint") / spec.slide_seconds)


def trending_keep_expired(
    tweets: DataFrame, spec: SlidingWindow = SlidingWindow(), k: int = 10
) -> DataFrame:
    """`window_end, rk, tag, cnt` with k rows for every window, once k tags were seen.

    The first and last window are found first, and the new tags of all slots are written once; all else is one plan.
    """
    spark = tweets.sparkSession
    live = trending(tweets, spec, k)
    ends = window_ends(tweets, spec)
    if ends is None:
        return live
    path = run_dir(spark, "first-ends")
    firsts = first_ends(tweets, spec, k)
    firsts.write.parquet(path)
    firsts = spark.read.schema(firsts.schema).parquet(path)
    lo = F.lit(ends.lo).cast(firsts.schema["end"].dataType)
    full = live.where(F.col("rk") == k).select(F.col("window_end").alias("end"))
    slide = F.make_dt_interval(secs=F.lit(spec.slide_seconds))
    grid = spark.range(ends.places).select(F.col("id").alias("place"), (lo + slide * F.col("id")).alias("end"))

    seen = smallest_until(
        firsts.select(steps(F.col("end") - lo, spec).alias("place"), "tag"),
        grid.join(full, "end", "left_anti"),
        "tag",
        k,
        ends.places,
        "tags",
    )
    zeros = seen.select(
        F.col("end").alias("window_end"), F.explode("tags").alias("tag"), F.lit(0).cast("bigint").alias("cnt")
    )
    states = (
        live.select("window_end", "tag", "cnt")
        .unionByName(zeros)
        .groupBy("window_end", "tag")
        .agg(F.max("cnt").alias("cnt"))
    )
    return top_k_per_group(states, ["window_end"], tag_order(), k).select(
        "window_end", "rk", "tag", "cnt"
    )
