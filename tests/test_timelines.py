import random
from datetime import datetime, timedelta

import pytest

from feedloom.plans import timelines

DAY = datetime(2024, 1, 1)
TWEETS = "tweet_id bigint, username string, created_at timestamp_ntz, text string"


@pytest.fixture(scope="module")
def feed(spark):
    rng = random.Random(5)
    names = [f"u{i}" for i in range(12)]
    tweets = [
        (i, "u0" if i % 3 == 0 else rng.choice(names), DAY + timedelta(minutes=rng.randrange(90)), f"t{i}")
        for i in range(240)  # many equal times
    ]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(40)} | {(n, "u0") for n in names}
    pairs.add(("u3", "u3"))
    return (
        tweets,
        pairs,
        spark.createDataFrame(tweets, TWEETS),
        spark.createDataFrame(sorted(pairs), "follower string, followee string"),
    )


def newest(tweets, k=10):
    return [t[0] for t in sorted(tweets, key=lambda t: (t[2], t[0]), reverse=True)[:k]]


def per(df, key):
    out = {}
    for r in df.orderBy(key, "rk").collect():
        out.setdefault(r[key], []).append(r.tweet_id)
    return out


@pytest.mark.parametrize("k", [3, 10])
@pytest.mark.parametrize("popular", [False, True])
def test_home_timelines(feed, k, popular):
    tweets, pairs, df, edges = feed
    limit = 5 if popular else 10**6
    want = {}
    for viewer in {a for a, _ in pairs}:
        followees = {b for a, b in pairs if a == viewer}
        want[viewer] = newest([t for t in tweets if t[1] in followees], k)
    assert per(timelines.home_timelines(df, edges, k, min_hot_rows=limit), "viewer") == want


def test_home_timeline_of_one(feed):
    tweets, pairs, df, edges = feed
    want = newest([t for t in tweets if ("u3", t[1]) in pairs])
    got = timelines.home_timeline(df, edges, "u3", 10).collect()
    assert [r.tweet_id for r in got] == want
    all_tweets = timelines.followee_tweets(df, edges, "u3").collect()
    assert {r.tweet_id for r in all_tweets} == {t[0] for t in tweets if ("u3", t[1]) in pairs}


def test_unknown_viewer_has_an_empty_home(feed):
    _, _, df, edges = feed
    assert timelines.home_timeline(df, edges, "nobody").count() == 0


def test_own_tweets_only_when_self_followed(spark, feed):
    _, _, df, _ = feed
    edges = spark.createDataFrame([("u1", "u2"), ("u3", "u3")], "follower string, followee string")
    rows = timelines.home_timelines(df, edges).collect()
    assert {(r.viewer, r.username) for r in rows} == {("u1", "u2"), ("u3", "u3")}


def test_profile_timelines(spark, feed):
    tweets, _, df, _ = feed
    users = spark.createDataFrame([("u0", "Zoe")], "username string, name string")
    result = timelines.profile_timelines(df, users)
    want = {n: newest([t for t in tweets if t[1] == n]) for n in {t[1] for t in tweets}}
    assert per(result, "username") == want
    titles = {(r.username == "u0", r.title) for r in result.collect()}
    assert titles == {(True, "Zoe's Profile:"), (False, None)}
    one = timelines.profile_timeline(df, "u0").collect()
    assert [r.tweet_id for r in one] == want["u0"]


def test_author_names(spark, feed):
    tweets, _, df, _ = feed
    users = spark.createDataFrame([("u0", "Zoe")], "username string, name string")
    rows = timelines.with_author_names(df, users).collect()
    assert len(rows) == len(tweets)
    assert all(r.name == ("Zoe" if r.username == "u0" else None) for r in rows)


def test_home_timeline_of_authors_who_share_a_tweet_id(spark):
    tweets = spark.createDataFrame([(1, "x", DAY, "from x"), (1, "y", DAY, "from y")], TWEETS)
    edges = spark.createDataFrame([("v", "x")], "follower string, followee string")
    shown = timelines.home_timelines(tweets, edges).select("viewer", "username", "text").collect()
    assert [tuple(r) for r in shown] == [("v", "x", "from x")]
