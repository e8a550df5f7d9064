"""The shape of the plans that have to hold at scale."""

import re

import pytest

from checks.queries import QUERIES
from feedloom import views
from feedloom.operators.accounts import first_per_key
from feedloom.plans import timelines, trending
from feedloom.sinks.tables import write_bucketed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EAGER = {n for n in QUERIES if n.startswith(("stream_", "bulk_load_"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tweets(spark):
    return views.tweets(spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - EAGER))
def test_no_query_pairs_rows_without_a_key_or_runs_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert bad not in text


def test_trending_limits_before_the_last_shuffle(tweets):
    text = plan(trending.trending(tweets))
    assert len(re.findall(r"WindowGroupLimit .* Partial", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in text


def test_slots_are_counted_before_the_shuffle(tweets):
    assert "partial_count" in plan(trending.hashtag_window_counts(tweets))


def test_global_top_takes_ordered(tweets):
    assert "TakeOrderedAndProject" in plan(trending.hashtag_top(tweets))


@pytest.mark.parametrize("name, table, scans", [
    ("follow_edges", "ts:timestamp_ntz|o_orderkey", 1),
    ("is_following", "event_id", 1),
    ("tweets_with_names", "event_id", 1),
    ("credential_outcomes", "o_orderpriority", 1),
    ("follow_unknown_users", "o_orderkey", 1),
])
def test_big_tables_are_read_once(spark, name, table, scans):
    """The number of scans that read a column which only the big side of the join gives."""
    text = plan(QUERIES[name](spark, SF))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sum(bool(re.search(table, columns)) for columns in read) == scans


def test_home_timelines_read_tweets_twice_and_edges_once(spark, tweets):
    edges = views.follow_events(spark, SF).select("follower", "followee").distinct()
    text = plan(timelines.home_timelines(tweets, edges))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sum("event_type" in columns for columns in read) == 1
    assert sum("event_id" in columns for columns in read) == 2
    assert sum("o_custkey" in columns for columns in read) == 1


def test_first_per_key_sends_one_row_per_task_and_key(tweets):
    text = plan(first_per_key(tweets, "username", [F.col("tweet_id")]))
    assert re.search(r"WindowGroupLimit .* 1, Partial", text)


def test_profile_cuts_before_the_join(spark, tweets):
    text = plan(timelines.profile_timelines(tweets, views.users(spark, SF)))
    assert text.index("LeftOuter") < text.index("WindowGroupLimit")


def test_bucketed_tables_join_without_a_shuffle(spark, tweets, tmp_path):
    users = views.users(spark, SF)
    write_bucketed(tweets, "plan_tweets", 4, path=str(tmp_path / "t"), spread_by=["tweet_id"])
    write_bucketed(users, "plan_users", 4, path=str(tmp_path / "u"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # Only to see the buckets in the plan; files are left out either way.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        joined = spark.table("plan_tweets").join(spark.table("plan_users"), "username", "left")
        assert "Exchange" not in plan(joined)
        one = spark.table("plan_tweets").where(F.col("username") == "user7")
        assert "SelectedBucketsCount: 1 out of 4" in plan(one)
        assert "PushedFilters: [IsNotNull(username), EqualTo(username,user7)]" in plan(one)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert joined.count() == tweets.count()


def test_busy_bucket_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "star").otherwise(F.concat(F.lit("u"), "id")).alias("username"),
        F.col("id").alias("tweet_id"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge so few rows
    try:
        write_bucketed(rows, "busy_tweets", 4, path=str(tmp_path / "b"), spread_by=["tweet_id"],
                       rows_per_file=100)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    written = spark.table("busy_tweets")
    assert written.count() == 3000 and written.select("tweet_id").distinct().count() == 3000
    star = written.where("username = 'star'").select(F.input_file_name().alias("f"))
    assert 2 <= star.distinct().count() <= 11
