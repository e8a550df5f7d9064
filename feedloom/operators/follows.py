"""The follow graph: events folded to edges, lists per user, relation checks.

Edges are `follower, followee, since_ts, since_seq`, one row per pair. (since_ts, since_seq)
is the event that put it in place and orders both the followers and the following
list of a user. Following again while following changes nothing; unfollow removes
the edge, and a later follow puts it at the end.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.times import wall_clock
from feedloom.operators.skew import MAX_HOT_KEYS, MIN_HOT_ROWS, hot_keys
from feedloom.session import run_dir

PAIR = ["follower", "followee"]
FOLLOW, UNFOLLOW = "follow", "unfollow"
SLICE = timedelta(days=30)


def standing(records: DataFrame) -> DataFrame:
    """One record per pair from any number of them: what `follow_records` gives, for several slices.

    Records of slices that don't overlap combine to what all their events give. Of overlapping ones, whether the
    pair stands and since when it left are right too; `since` may come out as a later
    follow, where the pair follows twice in a row and is unfollowed, late, in between.
    """
    left = F.max("left_at").over(Window.partitionBy(*PAIR))

    def behind(at: str) -> Column:
        return F.when(F.col("last_left").isNull() | (F.col(at) > F.col("last_left")), F.col(at))

    return (
        records.withColumn("last_left", left)
        .groupBy(*PAIR)
        .agg(
            F.max("last_left").alias("left_at"),
            F.min(F.coalesce(behind("since"), behind("followed_at"))).alias("since"),
            F.max("followed_at").alias("followed_at"),
        )
    )


def follow_records(events: DataFrame, slice_by: timedelta = SLICE) -> DataFrame:
    """`follower, followee, left_at, since, followed_at` per pair and slice of time: the last unfollow, the first
    follow after it (or the first of all), the last follow. All three are structs of (ts, seq).

    Rows without one of the names or a time are left out.
    """
    moves = events.where(F.col("follower").isNotNull() & F.col("followee").isNotNull()).select(
        *PAIR,
        F.window("ts", f"{int(slice_by.total_seconds())} seconds")["start"].alias("slice"),
        F.when(F.col("action") == FOLLOW, F.struct("ts", "seq")).alias("follow"),
        F.when(F.col("action") == UNFOLLOW, F.struct("ts", "seq")).alias("unfollow"),
    )
    left = F.max("unfollow").over(Window.partitionBy(*PAIR, "slice"))
    after = F.when(F.col("left").isNull() | (F.col("follow") > F.col("left")), F.col("follow"))
    return (
        moves.withColumn("left", left)
        .groupBy(*PAIR, "slice")
        .agg(F.max("left").alias("left_at"), F.min(after).alias("since"), F.max("follow").alias("followed_at"))
        .drop("slice")
    )


def edges_of(records: DataFrame) -> DataFrame:
    """Edges that stand, of one record per pair."""
    return records.where(F.col("since").isNotNull()).select(
        *PAIR, F.col("since.ts").alias("since_ts"), F.col("since.seq").alias("since_seq")
    )


def records_of(edges: DataFrame) -> DataFrame:
    """Edges as records, so that later ones can be added to them."""
    since = F.struct(F.col("since_ts").alias("ts"), F.col("since_seq").alias("seq"))
    return edges.select(*PAIR, F.lit(None).alias("left_at"), since.alias("since"), since.alias("followed_at"))


def fold_follow_events(events: DataFrame, slice_by: timedelta = SLICE) -> DataFrame:
    """Current edges after all events, in any input order.

    The events are read once. A pair's events are first reduced to one record per slice of time, so
    a pair that holds a large share of all events is spread over as many groups as it has slices, and
    only records meet.
    """
    return edges_of(standing(follow_records(events, slice_by)))


def apply_follow_events(edges: DataFrame, events: DataFrame, slice_by: timedelta = SLICE) -> DataFrame:
    """Edges after events that all come later than the ones the edges stand for."""
    later = follow_records(events.select(*PAIR, "action", "ts", "seq"), slice_by)
    return edges_of(standing(records_of(edges).unionByName(later)))


def edges_of_lists(
    lists: DataFrame, column: str, loaded_at: datetime
) -> DataFrame:
    """Edges of a table with one array per user; repeats in an array count once.

    `column` is "following" (out-edges) or "followers" (in-edges). The place in the
    array becomes since_seq, so the lists come back in their order.
    """
    owner, member = PAIR if column == "following" else PAIR[::-1]
    return (
        lists.select(F.col("username").alias(owner), F.posexplode(column).alias("pos", member))
        .where(F.col(member).isNotNull())
        .groupBy(*PAIR)
        .agg(F.min("pos").cast("bigint").alias("since_seq"))
        .withColumn("since_ts", wall_clock(loaded_at))
        .select(*PAIR, "since_ts", "since_seq")
    )


def mark_unknown(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with `follower_known` and `followee_known`; events that name an unknown
    user change nothing and belong into the rejects."""
    names = users.select("username").distinct()
    for side in PAIR:
        known = names.select(F.col("username").alias(side), F.lit(True).alias("_known"))
        events = (
            events.join(known, side, "left")
            .withColumn(f"{side}_known", F.coalesce("_known", F.lit(False)))
            .drop("_known")
        )
    return events


def positions_by_length(
    edges: DataFrame,
    side: str,
    max_hot_users: int = MAX_HOT_KEYS,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> tuple[DataFrame, DataFrame | None]:
    """`username, position, member` of the lists of ordinary length, and of the others if there are any.

    Lists of ordinary length are numbered by one window per user; there are at most `max_hot_users` others.
    """
    owner, member = PAIR if side == "following" else PAIR[::-1]
    rows = edges.select(
        F.col(owner).alias("username"), F.col(member).alias("member"), "since_ts", "since_seq"
    )
    hot = [r.username for r in hot_keys(rows, ["username"], max_hot_users, min_hot_rows).collect()]
    columns = ["username", F.col("position").cast("bigint").alias("position"), "member"]

    def numbered(lists: DataFrame) -> DataFrame:
        order = Window.partitionBy("username").orderBy("since_ts", "since_seq", "member")
        return lists.withColumn("position", F.row_number().over(order) - 1).select(*columns)

    if not hot:
        return numbered(rows), None
    spark = edges.sparkSession
    names = F.broadcast(spark.createDataFrame([(name,) for name in hot], rows.select("username").schema))
    long = numbered_in_ranges(rows.join(names, "username", "left_semi"))
    return numbered(rows.join(names, "username", "left_anti")), long.select(*columns)


def numbered_in_ranges(rows: DataFrame) -> DataFrame:
    """`rows` with their `position` in the list of their user, however long it is and whatever its times are.

    The rows are dealt to ranges of (username, time, number, member), numbered in each range, and moved by
    the length of the user's earlier ranges. The ranges are written, so that they are the same in all that
    follows.
    """
    order = ["since_ts", "since_seq", "member"]
    path = run_dir(rows.sparkSession, "ranges")
    placed = rows.repartitionByRange("username", *order).withColumn("range", F.spark_partition_id())
    placed.write.parquet(path)
    placed = rows.sparkSession.read.schema(placed.schema).parquet(path)
    earlier = Window.partitionBy("username").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("username", "range")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    within = F.row_number().over(Window.partitionBy("username", "range").orderBy(*order)) - 1
    return (
        placed.withColumn("within", within)
        .join(starts.select("username", "range", "start"), ["username", "range"])
        .withColumn("position", F.col("start") + F.col("within"))
    )


def list_positions(edges: DataFrame, side: str, **options) -> DataFrame:
    """`username, position, member` of every following or followers list, from 0."""
    short, long = positions_by_length(edges, side, **options)
    return short if long is None else short.unionByName(long)


def follow_lists(
    edges: DataFrame, side: str, page_size: int = 10_000, **options
) -> DataFrame:
    """`username, page, members`: the list in order, in pages of at most `page_size`.

    A list no longer than a page is one row, as stored; a longer one stays whole over
    several rows, so no array grows with the data. Ordinary lists are collected where
    they were numbered, without another shuffle.
    """

    def pages(positions: DataFrame) -> DataFrame:
        return (
            positions.withColumn("page", F.floor(F.col("position") / page_size).cast("bigint"))
            .groupBy("username", "page")
            .agg(F.array_sort(F.collect_list(F.struct("position", "member"))).alias("rows"))
            .select("username", "page", F.col("rows.member").alias("members"))
        )

    short, long = positions_by_length(edges, side, **options)
    return pages(short) if long is None else pages(short).unionByName(pages(long))


def list_of(edges: DataFrame, side: str, username: str) -> DataFrame:
    """The list of one user, in order."""
    owner, member = PAIR if side == "following" else PAIR[::-1]
    return (
        edges.where(F.col(owner) == username)
        .orderBy("since_ts", "since_seq", member)
        .select(F.col(member).alias("member"))
    )


def is_following(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """`requests(viewer, profile, ...)` with a column `following`.

    The requests are read once; adaptive execution splits those for a very popular profile.
    """
    pairs = edges.select(
        F.col("follower").alias("viewer"),
        F.col("followee").alias("profile"),
        F.lit(True).alias("_edge"),
    )
    return (
        requests.join(pairs, ["viewer", "profile"], "left")
        .withColumn("following", F.col("_edge").isNotNull())
        .drop("_edge")
    )


def lists_contain(lists: DataFrame, username: str) -> DataFrame:
    """`username, following_them`: does any page of the user's list hold `username`?

    One row per user, however many pages a list has. A missing array holds nobody.
    """
    held = F.coalesce(F.array_contains("following", username), F.lit(False))
    return lists.groupBy("username").agg(F.bool_or(held).alias("following_them"))


def add_to_lists(pages: DataFrame, name: str, page_size: int = 10_000) -> DataFrame:
    """`username, page, members` with `name` at the end of every list that lacks it.

    It joins the last page, or starts a page where that one is full, so the list's
    length doesn't change the result. A missing list starts with it.
    """
    members = F.coalesce("members", F.array().cast("array<string>"))
    pages = pages.select("username", "page", members.alias("members"))
    state = pages.groupBy("username").agg(
        F.bool_or(F.array_contains("members", name)).alias("_known"), F.max("page").alias("_last")
    )
    ends = ~F.col("_known") & (F.col("page") == F.col("_last"))
    full = F.size("members") >= page_size
    added = F.array(F.lit(name))
    # The last page yields itself, and with `name` one more where it is full.
    grown = F.when(ends & ~full, F.array(F.struct("page", F.concat("members", added).alias("members"))))
    split = F.when(
        ends & full,
        F.array(
            F.struct("page", "members"),
            F.struct((F.col("page") + 1).alias("page"), added.alias("members")),
        ),
    )
    same = F.array(F.struct("page", "members"))
    return (
        pages.join(state, "username")
        .select("username", F.explode(F.coalesce(grown, split, same)).alias("at"))
        .select("username", "at.page", "at.members")
    )


def remove_from_lists(pages: DataFrame, name: str) -> DataFrame:
    """The pages without `name`; a page keeps its number, also when it becomes empty."""
    return pages.select("username", "page", F.array_remove("members", name).alias("members"))


def one_sided_edges(following_edges: DataFrame, followers_edges: DataFrame) -> DataFrame:
    """Edges in only one of the two redundant tables: `follower, followee, only_in`."""
    sides = following_edges.select(*PAIR, F.lit(True).alias("out")).unionByName(
        followers_edges.select(*PAIR, F.lit(False).alias("out"))
    )
    return (
        sides.groupBy(*PAIR)
        .agg(F.bool_or("out").alias("out"), F.bool_or(~F.col("out")).alias("back"))
        .where(F.col("out") != F.col("back"))
        .select(*PAIR, F.when(F.col("out"), "following").otherwise("followers").alias("only_in"))
    )
