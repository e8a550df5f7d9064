import hashlib
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedloom.jobs import bulk_load as bulk_load_job
from feedloom.jobs import follows as follows_job
from feedloom.jobs import ingest as ingest_job
from feedloom.jobs import sign_ups as sign_ups_job
from feedloom.jobs import timelines as timelines_job
from feedloom.plans import bulk_load as plan
from feedloom.plans.bulk_load import bulk_load, feed_tables
from feedloom.sinks.versions import Folder, Versions
from feedloom.schemas import FOLLOW_EVENTS, POSTS, SIGN_UPS, StructType
from feedloom.schemas import TWEETS as TWEETS_SCHEMA
from feedloom.sinks.tables import write_indexed
from feedloom.sources.tables import find_user, find_users, read_batches, read_table

LOADED_AT = datetime(2014, 11, 23, 14, 5, 9)

USERS = [
    '{"username":"a","name":"Ann","followers":["b"],"following":["b","b","c"]}',
    "{bad",
    "",
    '{"username":"b","name":"Bob"}',
    '{"username":"a","name":"Other","followers":[],"following":["c"]}',
    '{"name":"Nobody"}',
    '{"username":"c","name":"Cy","followers":null,"following":[]}',
    '{"username":"a","name":"Third"}',
]
TWEETS = [
    '{"created_at":"2014-11-20T10:00:00Z","text":"hi #x","username":"b"}',
    '{"created_at":"Wed Aug 27 13:08:45 +0000 2008","text":"old","username":"c"}',
    '{"created_at":"nope","text":"when","username":"c"}',
    "not json",
    '{"created_at":"2014-11-20T10:00:00Z","text":"whose"}',
]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def load(spark, tmp_path):
    users = write(tmp_path / "users.json", USERS)
    tweets = write(tmp_path / "tweets.json", TWEETS)
    return bulk_load(spark, users, tweets, str(tmp_path / "feed"), LOADED_AT)


def test_bulk_load(spark, tmp_path):
    for _ in range(2):  # a second load replaces the first
        tables = load(spark, tmp_path)
    salt = hashlib.md5(b"a").hexdigest()[:10]
    users = {r.username: r for r in spark.read.parquet(tables.path("users")).collect()}
    assert {k: r.name for k, r in users.items()} == {"a": "Ann", "b": "Bob", "c": "Cy"}
    assert users["a"]["pass"] == salt + hashlib.md5(("a" + salt).encode()).hexdigest()
    assert users["a"]["date"] == "November 23rd 2014, 2:05:09 pm"

    following = {r.username: r.following for r in spark.read.parquet(tables.path("following")).collect()}
    assert following == {"a": ["b", "b", "c"], "b": None, "c": []}
    followers = {r.username: r.followers for r in spark.read.parquet(tables.path("followers")).collect()}
    assert followers == {"a": ["b"], "b": None, "c": None}

    tweets = spark.read.parquet(tables.path("tweets"))
    rows = sorted((r.username, r.created_at, r.text, r.name) for r in tweets.collect())
    assert rows == [
        ("b", datetime(2014, 11, 20, 10), "hi #x", None),
        ("c", datetime(2008, 8, 27, 13, 8, 45), "old", None),
    ]
    assert tweets.select("tweet_id").distinct().count() == 2

    rejects = [(r.input, r.reason) for r in spark.read.parquet(tables.path("rejects")).collect()]
    assert sorted(rejects) == [
        ("tweets", "bad_created_at"),
        ("tweets", "malformed"),
        ("tweets", "no_username"),
        ("users", "duplicate_username"),
        ("users", "duplicate_username"),
        ("users", "malformed"),
        ("users", "no_username"),
    ]


def test_failed_load_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    """Whatever step fails, readers keep all tables of the load before; the next load succeeds."""
    first = load(spark, tmp_path)
    feed = str(tmp_path / "feed")
    names = ["users", "following", "followers", "tweets", "rejects"]

    def content():
        tables = feed_tables(spark, feed)
        return [sorted(map(str, spark.read.parquet(tables.path(n)).collect())) for n in names]

    before = content()
    users = write(tmp_path / "more.json", ['{"username":"z","name":"Zed"}'])
    tweets = write(tmp_path / "none.json", TWEETS[:1])
    real = plan.replace_table
    for fails_at in ("first", "following", "rejects"):

        def broken(df, path, fails_at=fails_at):
            if path.endswith(f"/{fails_at}"):
                raise OSError("the disk is full")
            real(df, path)

        monkeypatch.setattr(plan, "replace_table", broken)
        with pytest.raises(OSError):
            bulk_load(spark, users, tweets, feed, LOADED_AT)
        assert feed_tables(spark, feed) == first and content() == before
    monkeypatch.setattr(plan, "replace_table", real)
    second = bulk_load(spark, users, tweets, feed, LOADED_AT)
    assert feed_tables(spark, feed) == second
    assert [r.username for r in spark.read.parquet(second.path("users")).collect()] == ["z"]
    # A job that was reading the first load still can.
    assert spark.read.parquet(first.path("users")).count() == 3
    assert "staging" not in Folder(spark, second.root).names()
    bulk_load(spark, users, tweets, feed, LOADED_AT)
    assert len(Versions(spark, feed).names()) == 2 and not (tmp_path / "feed" / first.root.rsplit("/", 1)[1]).exists()


def test_nothing_loaded(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feed_tables(spark, str(tmp_path))


def test_first_line_wins_over_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        write(folder / f"part-{i}.json", [
            f'{{"username":"same","name":"n{i}"}}', f'{{"username":"u{i}","name":"n"}}'])
    tweets = write(tmp_path / "tweets.json", TWEETS)
    tables = bulk_load(spark, str(folder), tweets, str(tmp_path / "feed"), LOADED_AT)
    users = {r.username: r.name for r in spark.read.parquet(tables.path("users")).collect()}
    assert users == {"same": "n0"} | {f"u{i}": "n" for i in range(6)}


def test_lookups(spark, tmp_path):
    path = load(spark, tmp_path).path("users")
    users = read_table(spark, path)
    assert [r.name for r in find_user(users, "b").collect()] == ["Bob"]
    assert find_user(users, "x").count() == 0
    asked = spark.createDataFrame([("a",), ("a",), ("x",)], "username string")
    assert [r.name for r in find_users(users, asked).collect()] == ["Ann"]
    named = read_table(spark, path, F.col("username") == "c")
    assert [r.name for r in named.collect()] == ["Cy"]


def test_jobs_from_lines_to_pages(spark, tmp_path):
    users = write(tmp_path / "users.json", USERS)
    tweets = write(tmp_path / "tweets.json", TWEETS)
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    bulk_load_job.main([users, tweets, feed])
    events = spark.createDataFrame(
        [("a", "c", "unfollow", LOADED_AT, 1), ("c", "a", "follow", LOADED_AT, 2),
         ("a", "nobody", "follow", LOADED_AT, 3)],
        "follower string, followee string, action string, ts timestamp_ntz, seq bigint",
    )
    events.write.parquet(f"{out}/events")
    timelines_job.main([feed, out, "--events", f"{out}/events"])
    homes = spark.read.parquet(f"{out}/homes").collect()
    assert [(r.viewer, r.username, r.rk, r.text) for r in homes] == [("a", "b", 1, "hi #x")]
    lists = {r.username: r.members for r in spark.read.parquet(f"{out}/following").collect()}
    assert lists == {"a": ["b"], "c": ["a"]}
    assert spark.read.parquet(f"{out}/profiles").count() == 2
    stored = {r.username: r.followers or [] for r in spark.read.parquet(feed_tables(spark, feed).path("followers")).collect()}
    kept = {r.username: r.members for r in spark.read.parquet(f"{out}/followers").collect()}
    for name, followers in stored.items():
        left = [f for f in dict.fromkeys(followers) if (f, name) != ("a", "c")]
        assert kept.get(name, []) == left + (["c"] if name == "a" and "c" not in left else [])
    sides = spark.read.parquet(f"{out}/asymmetry").collect()
    pairs = {(f, name) for name, fs in kept.items() for f in fs}
    both = {(name, f) for name, fs in lists.items() for f in fs}
    assert {(r.follower, r.followee) for r in sides} == pairs ^ both
    assert [r.seq for r in spark.read.parquet(f"{out}/rejects").collect()] == [3]


def test_streaming_jobs_on_a_loaded_feed(spark, tmp_path):
    users = write(tmp_path / "users.json", USERS)
    tweets = write(tmp_path / "tweets.json", TWEETS)
    feed, root = str(tmp_path / "feed"), str(tmp_path)
    bulk_load_job.main([users, tweets, feed])

    posted = [(1, LOADED_AT, "new #x", "b"), (2, LOADED_AT, "y" * 141, "b"), (3, None, "z", "nobody")]
    spark.createDataFrame(posted, POSTS).write.parquet(f"{root}/posts")
    ingest_job.main([f"{root}/posts", feed, f"{root}/ingest", "--rejects", f"{root}/rejects", "--once"])
    stored = read_batches(spark, feed_tables(spark, feed).path("tweets"), TWEETS_SCHEMA).collect()
    assert sorted((r.tweet_id, r.name) for r in stored if r.tweet_id > 0) == [(1, "Bob"), (3, None)]
    assert len(stored) == 4
    rejects = read_batches(spark, f"{root}/rejects", StructType([*POSTS]).add("problem", "string")).collect()
    assert [(r.tweet_id, r.problem) for r in rejects] == [(2, "too_long")]

    asked = [(1, "b", "Other"), (2, "d", "Dee"), (3, "d", "Again")]
    spark.createDataFrame(asked, SIGN_UPS).write.parquet(f"{root}/requests")
    for _ in range(2):  # the second run finds nothing new
        sign_ups_job.main([f"{root}/requests", feed, f"{root}/signed", "--once"])
    spark.createDataFrame([(4, "d", "Late"), (5, "e", "Eve")], SIGN_UPS).write.mode("append").parquet(f"{root}/requests")
    sign_ups_job.main([f"{root}/requests", feed, f"{root}/signed", "--once"])
    outcomes = spark.read.parquet(f"{root}/signed/outcomes")
    assert sorted((r.request_id, r.outcome) for r in outcomes.collect()) == [
        (1, "username-taken"), (2, "created"), (3, "username-taken"), (4, "username-taken"), (5, "created")]
    accounts = spark.read.parquet(f"{root}/signed/accounts").collect()
    assert sorted((r.username, r.name) for r in accounts) == [("d", "Dee"), ("e", "Eve")]

    events = [("a", "b", "follow", LOADED_AT, 1), ("a", "c", "follow", LOADED_AT, 2), ("a", "b", "unfollow", LOADED_AT, 3)]
    spark.createDataFrame(events, FOLLOW_EVENTS).write.parquet(f"{root}/events")
    follows_job.main([f"{root}/events", f"{root}/follows", "--once"])
    follows_job.main([f"{root}/follows", "--compact", "--lists", f"{root}/lists"])
    assert [tuple(r)[::2] for r in spark.read.parquet(f"{root}/lists/following").collect()] == [("a", ["c"])]
    assert [tuple(r)[::2] for r in spark.read.parquet(f"{root}/lists/followers").collect()] == [("c", ["a"])]


def test_lookups_skip_row_groups(spark, tmp_path):
    """A name between others lies within the bounds of a row group; the Bloom filter rules it out all the same."""
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select(
        F.format_string("user%06d", F.col("id") * 2).alias("username"), F.sha2(F.col("id").cast("string"), 256).alias("text")
    )
    write_indexed(rows, path, names=5_000, row_group_bytes=64 << 10)
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > 8

    def read(name):
        """Rows that leave the Parquet reader, and rows of the result."""
        df = read_table(spark, path, F.col("username") == name)
        found = len(df.collect())
        scans = df._jdf.queryExecution().executedPlan().collectLeaves()
        return scans.apply(0).metrics().apply("numOutputRows").value(), found

    largest = max(g.num_rows for g in groups)
    taken, found = read("user010000")
    assert found == 1 and 1 <= taken <= largest
    for absent in ("user010001", "user000123", "nobody"):
        assert read(absent) == (0, 0)
