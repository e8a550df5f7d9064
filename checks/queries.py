"""One query per operator, over the benchmark tables. Each has a twin in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom import views
from feedloom.functions import lists
from feedloom.functions.credentials import default_salt, salted_hash
from feedloom.functions.times import account_stamp, display_time, parse_created_at, utc_wall_clock, wall_clock
from feedloom.operators import accounts, follows
from feedloom.operators.sliding import SlidingWindow
from feedloom.plans import bulk_load, expired, posts, timelines, trending
from feedloom.schemas import TWEETS
from feedloom.session import run_dir
from feedloom.sinks import tables
from feedloom.sinks.topic import topic_records
from feedloom.sources.topic import message_posts, message_texts
from feedloom.sources.tables import find_user, find_users, read_batches, read_table, table_stream
from feedloom.streaming import follows as follow_streams
from feedloom.streaming import posts as post_streams
from feedloom.streaming import sign_ups as sign_up_streams
from feedloom.streaming import state as stream_states
from feedloom.streaming import trending as trending_streams
from feedloom.streaming.progress import ProgressTable

LOADED_AT = datetime(2014, 11, 23, 14, 5, 9)
ONE_USER = "user7"
ONCE = {"availableNow": True}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Hashtags ------------------------------------------------------------------------


@query
def hashtag_tokens(spark, sf):
    return trending.hashtag_tokens(views.tweets(spark, sf))


@query
def hashtag_totals(spark, sf):
    return trending.hashtag_totals(views.tweets(spark, sf))


@query
def hashtag_global_top10(spark, sf):
    return trending.hashtag_top(views.tweets(spark, sf))


@query
def hashtag_window_counts(spark, sf):
    return trending.hashtag_window_counts(views.tweets(spark, sf), form="expand")


@query
def hashtag_window_counts_chained(spark, sf):
    return trending.hashtag_window_counts(views.tweets(spark, sf), form="chained")


@query
def hashtag_window_counts_delta(spark, sf):
    return trending.hashtag_window_counts(views.tweets(spark, sf), form="delta")


@query
def trending_top10(spark, sf):
    return trending.trending(views.tweets(spark, sf))


@query
def trending_expand(spark, sf):
    return trending.trending(views.tweets(spark, sf), form="expand")


@query
def trending_keep_expired(spark, sf):
    return expired.trending_keep_expired(views.tweets(spark, sf))


@query
def trending_uneven(spark, sf):
    """Windows whose length is no multiple of the slide."""
    spec = SlidingWindow(timedelta(seconds=150), timedelta(minutes=1))
    return trending.trending(views.tweets(spark, sf), spec)


@query
def trending_keep_expired_7min(spark, sf):
    """A slide that doesn't divide a day."""
    spec = SlidingWindow(timedelta(minutes=70), timedelta(minutes=7))
    return expired.trending_keep_expired(views.tweets(spark, sf), spec)


@query
def trending_keep_expired_36h(spark, sf):
    """A slide longer than a day."""
    spec = SlidingWindow(timedelta(hours=72), timedelta(hours=36))
    return expired.trending_keep_expired(views.tweets(spark, sf), spec)


@query
def trending_report_text(spark, sf):
    return trending.report_text(trending.trending(views.tweets(spark, sf)))


# Follow graph ----------------------------------------------------------------------


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return follows.fold_follow_events(views.follow_events(spark, sf))


def edges_table(spark: SparkSession, sf: str) -> DataFrame:
    """The edges as a written table, which lists and timelines read."""
    path = f"{run_dir(spark, 'edges')}/table"
    tables.replace_table(edges(spark, sf), path)
    return spark.read.parquet(path)


@query
def follow_edges(spark, sf):
    return edges(spark, sf)


@query
def follow_edges_incremental(spark, sf):
    """Edges up to a date, then the later events applied to them."""
    events = views.follow_events(spark, sf)
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    path = f"{run_dir(spark, 'edges')}/before"
    tables.replace_table(follows.fold_follow_events(events.where(F.col("ts") < cut)), path)
    before = spark.read.parquet(path)
    return follows.apply_follow_events(before, events.where(F.col("ts") >= cut))


def joined_lists(pages: DataFrame) -> DataFrame:
    return pages.select(
        "username",
        "page",
        F.size("members").cast("bigint").alias("n"),
        F.array_join("members", ",").alias("members"),
    )


@query
def following_lists(spark, sf):
    return joined_lists(follows.follow_lists(edges_table(spark, sf), "following"))


@query
def followers_lists(spark, sf):
    return joined_lists(follows.follow_lists(edges_table(spark, sf), "followers"))


@query
def followers_lists_paged(spark, sf):
    """Pages of 4, with every user treated as one of very many followers."""
    return joined_lists(
        follows.follow_lists(edges_table(spark, sf), "followers", page_size=4, min_hot_rows=1)
    )


@query
def long_loaded_list(spark, sf):
    """One user follows all customers, loaded as a list: all its edges have one time."""
    customers = views.table(spark, sf, "customer")
    star = customers.select(
        views.username(F.lit(0)).alias("follower"),
        views.username(F.col("c_custkey")).alias("followee"),
        wall_clock(LOADED_AT).alias("since_ts"),
        (F.col("c_custkey") * 7 % 1000).cast("bigint").alias("since_seq"),
    )
    others = edges(spark, sf).where(F.col("follower") != "user0")
    path = f"{run_dir(spark, 'edges')}/table"
    tables.replace_table(star.unionByName(others), path)
    return follows.list_positions(spark.read.parquet(path), "following", min_hot_rows=20)


@query
def following_positions(spark, sf):
    return follows.list_positions(edges_table(spark, sf), "following")


@query
def is_following(spark, sf):
    return follows.is_following(
        views.page_views(spark, sf), edges_table(spark, sf)
    )


@query
def lists_contain(spark, sf):
    stored = follows.follow_lists(edges_table(spark, sf), "following").withColumnRenamed(
        "members", "following"
    )
    return follows.lists_contain(stored, ONE_USER)


@query
def lists_contain_paged(spark, sf):
    stored = follows.follow_lists(edges_table(spark, sf), "following", page_size=4)
    return follows.lists_contain(stored.withColumnRenamed("members", "following"), ONE_USER)


def whole_lists(pages: DataFrame, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("page", "members")))["members"]
    return pages.groupBy("username").agg(F.array_join(F.flatten(parts), ",").alias(name))


def updated_lists(spark: SparkSession, sf: str, page_size: int) -> DataFrame:
    """Every stored list with ONE_USER followed, and with ONE_USER unfollowed."""
    stored = follows.follow_lists(edges_table(spark, sf), "following", page_size)
    followed = whole_lists(follows.add_to_lists(stored, ONE_USER, page_size), "followed")
    unfollowed = whole_lists(follows.remove_from_lists(stored, ONE_USER), "unfollowed")
    return followed.join(unfollowed, "username")


@query
def list_updates(spark, sf):
    return updated_lists(spark, sf, 10_000)


@query
def list_updates_paged(spark, sf):
    return updated_lists(spark, sf, 4)


@query
def list_updates_one_page(spark, sf):
    """The same where a list is known to be one array."""
    name, members = F.lit(ONE_USER), F.col("members")
    stored = follows.follow_lists(edges_table(spark, sf), "following")
    return stored.select(
        "username",
        F.array_join(lists.add_if_absent(members, name), ",").alias("followed"),
        F.array_join(lists.remove(members, name), ",").alias("unfollowed"),
    )


@query
def follow_asymmetry(spark, sf):
    """The followers side misses the events of low priority orders."""
    orders = views.table(spark, sf, "orders")
    n = views.user_count(spark, sf)
    arrived = orders.where(F.col("o_orderpriority") != "5-LOW")
    return follows.one_sided_edges(
        edges(spark, sf), follows.fold_follow_events(views.follow_columns(arrived, n))
    )


@query
def follow_unknown_users(spark, sf):
    """Follow events of all customers, of whom only those who post are users."""
    events = views.table(spark, sf, "orders").select(
        views.username(F.col("o_custkey")).alias("follower"),
        views.username(F.col("o_orderkey") % 1000).alias("followee"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )
    return follows.mark_unknown(events, views.users(spark, sf))


# Timelines -------------------------------------------------------------------------


@query
def tweets_with_names(spark, sf):
    return timelines.with_author_names(views.tweets(spark, sf), views.users(spark, sf))


@query
def tweets_with_names_bucketed(spark, sf):
    """The same from two tables laid out by username: a join without a shuffle."""
    root = run_dir(spark, "bucketed")
    label = root.rsplit("-", 1)[1]
    written, known = f"tweets_{label}", f"users_{label}"
    tables.write_bucketed(
        views.tweets(spark, sf), written, 8, path=f"{root}/tweets", spread_by=["tweet_id"]
    )
    tables.write_bucketed(views.users(spark, sf), known, 8, path=f"{root}/users")
    return spark.table(written).join(spark.table(known), "username", "left")


@query
def profile_timeline(spark, sf):
    return timelines.profile_timelines(views.tweets(spark, sf), views.users(spark, sf))


@query
def profile_timeline_one(spark, sf):
    return timelines.profile_timeline(views.tweets(spark, sf), ONE_USER)


@query
def home_timeline(spark, sf):
    return timelines.home_timelines(views.tweets(spark, sf), edges_table(spark, sf))


@query
def home_timeline_salted(spark, sf):
    """Home timelines with every followee of 5 or more treated as a very popular one."""
    return timelines.home_timelines(
        views.tweets(spark, sf), edges_table(spark, sf), min_hot_rows=5
    )


@query
def home_timeline_shared_ids(spark, sf):
    """Tweets numbered per author, so that all authors use the same ids."""
    tweets = views.tweets(spark, sf)
    number = F.row_number().over(Window.partitionBy("username").orderBy("tweet_id"))
    tweets = tweets.withColumn("tweet_id", number.cast("bigint"))
    return timelines.home_timelines(tweets, edges_table(spark, sf))


def edges_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of one follower: no other's events are shuffled."""
    events = views.follow_events(spark, sf)
    return follows.fold_follow_events(events.where(F.col("follower") == ONE_USER))


@query
def home_timeline_one(spark, sf):
    return timelines.home_timeline(views.tweets(spark, sf), edges_of_one(spark, sf), ONE_USER)


@query
def followee_tweets(spark, sf):
    return timelines.followee_tweets(views.tweets(spark, sf), edges_of_one(spark, sf), ONE_USER)


@query
def home_titles(spark, sf):
    return timelines.home_titles(views.users(spark, sf))


# Accounts and dates ----------------------------------------------------------------


@query
def find_one_user(spark, sf):
    return find_user(views.users(spark, sf), ONE_USER)


@query
def lookup_by_index(spark, sf):
    """Tweets of one user from a table that is laid out for it."""
    path = f"{run_dir(spark, 'indexed')}/tweets"
    tables.write_indexed(views.tweets(spark, sf), path)
    return read_table(spark, path, F.col("username") == ONE_USER).drop("text")


@query
def find_many_users(spark, sf):
    """Rows of all users that some follow event names as followee."""
    wanted = views.follow_events(spark, sf).select(F.col("followee").alias("username"))
    return find_users(views.users(spark, sf), wanted)


@query
def display_times(spark, sf):
    return views.tweets(spark, sf).select(
        "tweet_id", display_time(F.col("created_at")).alias("display_time")
    )


@query
def account_stamps(spark, sf):
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        account_stamp(
            F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
        ).alias("stamp"),
    )


@query
def parsed_dates(spark, sf):
    raw = F.get_json_object("value", "$.created_at")
    return views.tweet_lines(spark, sf).select(
        F.col("key").alias("tweet_id"),
        utc_wall_clock(parse_created_at(raw)).alias("created_at"),
    )


@query
def parsed_date_forms(spark, sf):
    """Every form a client may send, and times without a date."""
    events = views.table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("tweet_id"),
        utc_wall_clock(parse_created_at(views.date_form("event_id", "ts"))).alias("created_at"),
    )


@query
def users_dedup(spark, sf):
    """One account per name part of the event stream: the first event of each user."""
    return accounts.first_per_key(
        views.tweets(spark, sf).select("username", "created_at", "tweet_id"),
        "username",
        [F.col("created_at"), F.col("tweet_id")],
    )


@query
def users_not_taken(spark, sf):
    """Customers as new accounts, users who post as the stored ones."""
    customers = views.table(spark, sf, "customer").select(
        views.username(F.col("c_custkey")).alias("username"), F.col("c_name").alias("name")
    )
    return accounts.not_taken(customers, views.users(spark, sf))


def sign_up_requests(events: DataFrame) -> DataFrame:
    """Every event asks for the name of its user."""
    return events.select(
        F.col("event_id").alias("request_id"),
        views.username(F.col("user_id")).alias("username"),
        F.concat(F.lit("Name "), "event_type").alias("name"),
    )


def names_before(spark: SparkSession, sf: str) -> DataFrame:
    """Some customers have theirs already."""
    customers = views.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return customers.select(views.username(F.col("c_custkey")).alias("username"))


def sign_ups(spark: SparkSession, sf: str) -> DataFrame:
    requests = sign_up_requests(views.table(spark, sf, "events"))
    return accounts.sign_up_outcomes(requests, names_before(spark, sf))


@query
def sign_up_outcomes(spark, sf):
    return sign_ups(spark, sf)


@query
def new_accounts(spark, sf):
    return accounts.new_accounts(sign_ups(spark, sf), wall_clock(LOADED_AT))


def stored_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.with_credentials(
        views.users(spark, sf), wall_clock(LOADED_AT)
    )


@query
def account_credentials(spark, sf):
    return stored_accounts(spark, sf)


@query
def credential_outcomes(spark, sf):
    return accounts.attempt_outcomes(
        views.login_attempts(spark, sf), stored_accounts(spark, sf)
    )


@query
def default_passwords(spark, sf):
    """Users whose names have an odd length have set a password of their own."""
    name = F.col("username")
    changed = salted_hash(F.lit("my own"), default_salt(name))
    stored = stored_accounts(spark, sf)
    return accounts.default_passwords(
        stored.withColumn("pass", F.when(F.length(name) % 2 == 1, changed).otherwise(F.col("pass")))
    )


# Posts and bulk load ---------------------------------------------------------------


@query
def tweet_length_rejects(spark, sf):
    """Documents as posts: most are longer than a post may be."""
    texts = views.table(spark, sf, "documents").select("doc_id", "text")
    return posts.check_texts(texts).select("doc_id", "problem")


@query
def new_tweet_records(spark, sf):
    return posts.tweet_records(views.tweets(spark, sf), views.users(spark, sf))


@query
def posts_without_times(spark, sf):
    """Posts of which some come without a time, which get the one of the run."""
    tweets = views.tweets(spark, sf)
    failed = F.col("text").contains("#error ")
    timed = tweets.withColumn("created_at", F.when(~failed, F.col("created_at")))
    records = posts.tweet_records(timed, views.users(spark, sf))
    return records.select(
        "tweet_id", (F.col("created_at") > F.lit("2025-01-01").cast("timestamp_ntz")).alias("stamped_now")
    )


def topic_table(spark: SparkSession, sf: str, as_json: bool) -> DataFrame:
    """Tweets as messages, in the columns in which a topic is read."""
    records = topic_records(views.tweets(spark, sf), as_json)
    return records.select(
        F.col("value").cast("binary").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("timestamp")
    )


@query
def topic_messages(spark, sf):
    """Hashtags of messages that hold the bare text."""
    return trending.hashtag_totals(message_texts(topic_table(spark, sf, as_json=False)))


@query
def topic_message_posts(spark, sf):
    """Trending of messages that carry the time of their post."""
    messages = message_posts(topic_table(spark, sf, as_json=True))
    at = utc_wall_clock(F.col("ts")).alias("created_at")
    return trending.trending(messages.select(at, "text"))


def loaded(spark: SparkSession, sf: str) -> bulk_load.FeedTables:
    root = run_dir(spark, "load")
    views.write_lines(views.user_lines(spark, sf), f"{root}/in/users")
    views.write_lines(views.tweet_lines(spark, sf), f"{root}/in/tweets")
    return bulk_load.bulk_load(
        spark, f"{root}/in/users", f"{root}/in/tweets", f"{root}/out", LOADED_AT
    )


@query
def load_twice(spark, sf):
    """Two loads into one folder; the second, of other lines, replaces all tables of the first."""
    root = run_dir(spark, "load")
    for segment in ("MACHINERY", "BUILDING"):
        lines = views.user_lines(spark, sf).where(F.col("value").startswith("{") & (F.col("part") == 0))
        lines = lines.join(
            views.table(spark, sf, "customer").where(F.col("c_mktsegment") == segment),
            F.col("key") == F.col("c_custkey"),
            "left_semi",
        )
        views.write_lines(lines, f"{root}/in/{segment}")
        views.write_lines(views.tweet_lines(spark, sf).where(F.col("key") % 100 == 0), f"{root}/tweets/{segment}")
        bulk_load.bulk_load(spark, f"{root}/in/{segment}", f"{root}/tweets/{segment}", f"{root}/out", LOADED_AT)
    stored = bulk_load.feed_tables(spark, f"{root}/out")
    users = spark.read.parquet(stored.path("users")).select(F.lit("user").alias("kind"), F.col("username").alias("name"))
    posted = read_batches(spark, stored.path("tweets"), TWEETS)
    return users.unionByName(posted.select(F.lit("tweet").alias("kind"), F.col("username").alias("name")))


@query
def bulk_load_users(spark, sf):
    return spark.read.parquet(loaded(spark, sf).path("users"))


@query
def bulk_load_following_edges(spark, sf):
    stored = spark.read.parquet(loaded(spark, sf).path("following"))
    return follows.edges_of_lists(stored, "following", LOADED_AT)


@query
def bulk_load_followers(spark, sf):
    stored = spark.read.parquet(loaded(spark, sf).path("followers"))
    return stored.select("username", F.array_join("followers", ",").alias("followers"))


@query
def stored_followers_lists(spark, sf):
    """Followers lists from the loaded followers, whatever the following side holds."""
    stored = spark.read.parquet(loaded(spark, sf).path("followers"))
    return joined_lists(
        follows.follow_lists(follows.edges_of_lists(stored, "followers", LOADED_AT), "followers")
    )


@query
def bulk_load_tweets(spark, sf):
    return read_batches(spark, loaded(spark, sf).path("tweets"), TWEETS).drop("tweet_id")


@query
def bulk_load_rejects(spark, sf):
    return spark.read.parquet(loaded(spark, sf).path("rejects"))


# Streams ---------------------------------------------------------------------------


def finished(stream) -> None:
    stream.awaitTermination()


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    return views.tweet_columns(table_stream(spark, sf, schema, files="events.parquet"))


def drained(spark: SparkSession, sf: str, reports: bool = False) -> str:
    """Folder of a trending stream over all events, with all windows closed."""
    root = run_dir(spark, "trending")
    messages = event_stream(spark, sf).select(F.col("created_at").alias("ts"), "text")
    trending_streams.drain(
        messages,
        f"{root}/table",
        f"{root}/checkpoint",
        f"{root}/marks",
        delay="0 seconds",
        reports=f"{root}/reports" if reports else None,
    )
    return root


def in_utc(df: DataFrame) -> DataFrame:
    return df.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query
def stream_trending(spark, sf):
    ranking = spark.read.parquet(f"{drained(spark, sf)}/table")
    return in_utc(ranking).select("window_end", "rk", "tag", "cnt")


@query
def stream_trending_clock(spark, sf):
    """A stream that looks for messages every second until it is told to stop, its last windows closed."""
    root = run_dir(spark, "clock")
    messages = event_stream(spark, sf).select(F.col("created_at").alias("ts"), "text")
    stream = trending_streams.trending_stream(
        messages, f"{root}/table", f"{root}/checkpoint", delay="0 seconds", marks=f"{root}/marks"
    )
    try:
        stream.processAllAvailable()
        trending_streams.mark_end(spark, f"{root}/marks", f"{root}/checkpoint", delay="0 seconds")
        stream.processAllAvailable()
    finally:
        stream.stop()
    return in_utc(spark.read.parquet(f"{root}/table")).select("window_end", "rk", "tag", "cnt")


@query
def stream_trending_reports(spark, sf):
    reports = spark.read.parquet(f"{drained(spark, sf, reports=True)}/reports")
    return in_utc(reports).select("window_end", "report")


def streamed_follows(spark: SparkSession, sf: str, parts: int = 1, compacted: bool = False) -> str:
    """Folder of a follow stream over all orders, in as many runs as `parts`, each from files of its own."""
    root = run_dir(spark, "follows")
    orders = views.table(spark, sf, "orders")
    # Streams take no subqueries: the number of users is read first, as one value.
    n = views.table(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]
    for part in range(parts):
        if parts > 1:
            # By time: of each pair the earlier events come first.
            year = F.year("o_orderdate")
            mine = orders.where(F.least(F.greatest(year - 1993, F.lit(0)), F.lit(parts - 1)) == part)
            tables.append_table(mine, f"{root}/in")
            source = table_stream(spark, f"{root}/in", orders.schema)
        else:
            source = table_stream(spark, sf, orders.schema, files="orders.parquet")
        finished(
            follow_streams.follow_stream(
                views.follow_columns(source, F.lit(n)), f"{root}/follows", f"{root}/checkpoint", trigger=ONCE
            )
        )
        if compacted:
            follow_streams.compact(spark, f"{root}/follows")
    return f"{root}/follows"


MIDDLE = "2024-01-16"


def halves_of_events(spark: SparkSession, sf: str, folder: str, second: Column):
    """Adds the events to `folder` in two steps, those of `second` in the second; yields the stream after each."""
    events = views.table(spark, sf, "events")
    for part in (~second, second):
        tables.append_table(events.where(part), folder)
        yield table_stream(spark, folder, events.schema)


def later_half() -> Column:
    return F.col("ts") >= F.lit(MIDDLE).cast("timestamp_ntz")


def messages_of(events: DataFrame) -> DataFrame:
    return views.tweet_columns(events).select(F.col("created_at").alias("ts"), "text")


@query
def stream_sign_ups(spark, sf):
    """Requests in two runs of the stream: names of the first run are taken in the second."""
    root = run_dir(spark, "sign-ups")
    for events in halves_of_events(spark, sf, f"{root}/in", later_half()):
        finished(
            sign_up_streams.sign_up_stream(
                sign_up_requests(events),
                lambda session: names_before(session, sf),
                root,
                f"{root}/checkpoint",
                trigger=ONCE,
            )
        )
    return spark.read.parquet(f"{root}/{sign_up_streams.OUTCOMES}").drop(tables.WRITER, tables.BATCH)


@query
def restarted_stream_state(spark, sf):
    """State of a trending stream when it has stopped, and when it has gone on and stopped again."""
    root = run_dir(spark, "state")
    states = []
    for run, events in enumerate(halves_of_events(spark, sf, f"{root}/in", later_half()), 1):
        finished(
            trending_streams.trending_stream(
                messages_of(events), f"{root}/table", f"{root}/checkpoint", delay="0 seconds", trigger=ONCE
            )
        )
        # The next run changes what the checkpoint says.
        counts = stream_states.open_counts(spark, f"{root}/checkpoint")
        tables.replace_table(counts.withColumn("run", F.lit(run)), f"{root}/state/{run}")
        states.append(spark.read.parquet(f"{root}/state/{run}"))
    both = states[0].unionByName(states[1])
    return both.withColumn("end", F.col("end").cast("timestamp_ntz"))


@query
def stream_late_rows(spark, sf):
    """Every third event comes in a second run; what is then over six hours old is late."""
    root = run_dir(spark, "late")
    progress = ProgressTable(spark, f"{root}/progress")
    try:
        for events in halves_of_events(spark, sf, f"{root}/in", F.col("event_id") % 3 == 0):
            run = trending_streams.trending_stream(
                messages_of(events), f"{root}/table", f"{root}/checkpoint", delay="6 hours", trigger=ONCE
            )
            finished(run)
            progress.wait_for(run)
    finally:
        progress.close()
    sums = [F.sum(c).alias(c) for c in ("rows", "dropped")]
    return progress.read().agg(*sums)


@query
def stream_follow_state(spark, sf):
    return follow_streams.followed_pairs(spark, streamed_follows(spark, sf))


@query
def follow_state_compacted(spark, sf):
    """Four runs of the stream, each followed by a compaction; with the order of the lists."""
    return follow_streams.followed_edges(spark, streamed_follows(spark, sf, 4, compacted=True))


@query
def streamed_following_lists(spark, sf):
    """Lists in order from a snapshot and the batches after it."""
    root = streamed_follows(spark, sf, 3)
    follow_streams.compact(spark, root)
    path = f"{run_dir(spark, 'edges')}/table"
    tables.replace_table(follow_streams.followed_edges(spark, root), path)
    return joined_lists(follows.follow_lists(spark.read.parquet(path), "following"))


def ingested(spark: SparkSession, sf: str, tweets: str | None = None) -> str:
    root = run_dir(spark, "posts")
    finished(
        post_streams.post_stream(
            event_stream(spark, sf),
            lambda session: views.users(session, sf),
            tweets or f"{root}/tweets",
            f"{root}/checkpoint",
            send=post_streams.to_table(f"{root}/topic"),
            rejects=f"{root}/rejects",
            trigger=ONCE,
        )
    )
    return root


@query
def stream_post_ingest(spark, sf):
    return read_batches(spark, f"{ingested(spark, sf)}/tweets", TWEETS)


@query
def ingest_after_load(spark, sf):
    """Loaded tweets and, in the same table, the posts of two streams."""
    path = loaded(spark, sf).path("tweets")
    ingested(spark, sf, path)
    ingested(spark, sf, path)
    return read_batches(spark, path, TWEETS).drop("tweet_id")


@query
def stream_relayed_topic(spark, sf):
    """Messages sent from the written tweets table, with how often each was sent."""
    root = ingested(spark, sf)
    finished(
        post_streams.relay_stream(
            table_stream(spark, f"{root}/tweets/*/*", TWEETS),
            f"{root}/relay",
            send=post_streams.to_table(f"{root}/relayed"),
            trigger=ONCE,
        )
    )
    messages = spark.read.parquet(f"{root}/relayed")
    return messages.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_post_topic(spark, sf):
    """Messages of the topic with how often each was sent."""
    messages = spark.read.parquet(f"{ingested(spark, sf)}/topic")
    return messages.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
