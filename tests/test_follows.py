import random
from datetime import datetime, timedelta

import pytest

from feedloom.operators import follows

SCHEMA = "follower string, followee string, action string, ts timestamp_ntz, seq bigint"
DAY = datetime(2024, 1, 1)


def random_events(seed, n=300, users=6):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        rows.append((
            f"u{rng.randrange(users)}",
            f"u{rng.randrange(users)}",
            rng.choice(["follow", "follow", "unfollow"]),
            DAY + timedelta(hours=rng.randrange(200)),  # many equal times
            seq,
        ))
    return rows


def replay(rows):
    """Follow and unfollow one by one on two tables of lists."""
    following, followers = {}, {}
    for follower, followee, action, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        for table, owner, member in ((following, follower, followee), (followers, followee, follower)):
            members = table.setdefault(owner, [])
            if action == "unfollow":
                if member in members:
                    members.remove(member)
            elif member not in members:
                members.append(member)
    return ({k: v for k, v in t.items() if v} for t in (following, followers))


def stored(spark, edges):
    """Edges as a table, as the list jobs read them."""
    return spark.createDataFrame(edges.collect(), edges.schema)


def lists(df):
    pages = {}
    for r in df.orderBy("username", "page").collect():
        pages.setdefault(r.username, []).extend(r.members)
    return pages


@pytest.mark.parametrize("seed, limit, hours", [(0, 1, 1), (1, 12, 30), (2, 10**6, 10**5)])
def test_fold_equals_replay(spark, seed, limit, hours):
    rows = random_events(seed)
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    edges = stored(spark, follows.fold_follow_events(events, timedelta(hours=hours)))
    following, followers = replay(rows)
    assert lists(follows.follow_lists(edges, "following", min_hot_rows=limit)) == following
    assert lists(follows.follow_lists(edges, "followers", min_hot_rows=limit)) == followers
    assert lists(follows.follow_lists(edges, "followers", page_size=2)) == followers


def test_one_pair_with_a_third_of_all_events(spark):
    rows = random_events(9, 200) + [
        ("bot", "star", "unfollow" if i % 7 == 3 else "follow", DAY + timedelta(minutes=i), 1000 + i)
        for i in range(100)
    ]
    edges = stored(
        spark, follows.fold_follow_events(spark.createDataFrame(rows, SCHEMA), timedelta(minutes=10))
    )
    following, _ = replay(rows)
    assert lists(follows.follow_lists(edges, "following")) == following
    since = edges.where("follower = 'bot'").first().since_seq
    assert since == 1095  # first follow after the last unfollow at 94


CASES = [
    ("+b +b", ["b"]),
    ("+b +c -b +b", ["c", "b"]),
    ("-b", []),
    ("-b +b", ["b"]),
    ("+a", ["a"]),
    ("+b -b", []),
]


def test_cases(spark):
    rows = []
    for case, (actions, _) in enumerate(CASES):
        for seq, (sign, who) in enumerate(actions.split()):
            action = "follow" if sign == "+" else "unfollow"
            rows.append((f"a{case}", who, action, DAY, 10 * case + seq))
    edges = stored(spark, follows.fold_follow_events(spark.createDataFrame(rows, SCHEMA)))
    for case, (_, following) in enumerate(CASES):
        got = follows.list_of(edges, "following", f"a{case}").collect()
        assert [r.member for r in got] == following


def test_later_events_apply_to_edges(spark):
    rows = sorted(random_events(4), key=lambda r: (r[3], r[4]))
    first, rest = rows[:150], rows[150:]
    edges = stored(spark, follows.fold_follow_events(spark.createDataFrame(first, SCHEMA)))
    later = spark.createDataFrame(rest, SCHEMA)
    edges = stored(spark, follows.apply_follow_events(edges, later))
    following, _ = replay(rows)
    assert lists(follows.follow_lists(edges, "following")) == following


def test_edges_of_lists(spark):
    rows = [("a", ["c", "b", "c", None]), ("b", None), ("c", [])]
    table = spark.createDataFrame(rows, "username string, following array<string>")
    edges = follows.edges_of_lists(table, "following", DAY)
    assert lists(follows.follow_lists(edges, "following")) == {"a": ["c", "b"]}
    reverse = table.withColumnRenamed("following", "followers")
    back = follows.edges_of_lists(reverse, "followers", DAY)
    assert lists(follows.follow_lists(back, "followers")) == {"a": ["c", "b"]}


def test_is_following(spark):
    edges = spark.createDataFrame([("a", "b", DAY, 1)], "follower string, followee string, since_ts timestamp_ntz, since_seq bigint")
    requests = [(1, "a", "b"), (2, "b", "a"), (3, "nobody", "b"), (4, "a", "b"), (5, None, "b")]
    df = spark.createDataFrame(requests, "id int, viewer string, profile string")
    got = follows.is_following(df, edges).orderBy("id").collect()
    assert [r.following for r in got] == [True, False, False, True, False]


def test_lists_contain(spark):
    rows = [("a", ["b"]), ("b", []), ("c", None)]
    df = spark.createDataFrame(rows, "username string, following array<string>")
    got = follows.lists_contain(df, "b").orderBy("username").collect()
    assert [r.following_them for r in got] == [True, False, False]


def test_one_sided_edges(spark):
    def side(pairs):
        return spark.createDataFrame(pairs, "follower string, followee string")

    got = follows.one_sided_edges(side([("a", "b"), ("a", "c")]), side([("a", "b"), ("d", "a")]))
    assert sorted(map(tuple, got.collect())) == [("a", "c", "following"), ("d", "a", "followers")]


def test_unknown_users_are_marked(spark):
    users = spark.createDataFrame([("a",), ("b",)], "username string")
    rows = [("a", "b", "follow", DAY, 1), ("a", "x", "follow", DAY, 2), ("x", "a", "follow", DAY, 3)]
    got = follows.mark_unknown(spark.createDataFrame(rows, SCHEMA), users).orderBy("seq").collect()
    assert [(r.follower_known, r.followee_known) for r in got] == [
        (True, True), (True, False), (False, True)]


def test_records_combine_in_any_grouping(spark):
    """Records of slices of time give the same, however many are combined first."""
    rows = sorted(random_events(6, 240, 3), key=lambda r: (r[3], r[4]))
    parts = [follows.follow_records(spark.createDataFrame(rows[i : i + 60], SCHEMA)) for i in range(0, 240, 60)]
    a, b, c, d = (stored(spark, p) for p in parts)
    whole = follows.follow_records(spark.createDataFrame(rows, SCHEMA), timedelta(days=10**4))

    def result(records):
        return sorted(map(str, follows.standing(records).collect()))

    want = result(whole)
    assert result(a.unionByName(b).unionByName(c).unionByName(d)) == want
    left = stored(spark, follows.standing(a.unionByName(b)))
    right = stored(spark, follows.standing(c.unionByName(d)))
    assert result(left.unionByName(right)) == want
    middle = stored(spark, follows.standing(b.unionByName(c)))
    assert result(a.unionByName(middle).unionByName(d)) == want


def test_late_events_keep_the_pairs_right(spark):
    """Records of overlapping slices: pairs and last unfollows are right."""
    rows = random_events(8, 200, 4)
    parts = [stored(spark, follows.follow_records(spark.createDataFrame(rows[i::3], SCHEMA))) for i in range(3)]
    got = follows.standing(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    want = follows.standing(follows.follow_records(spark.createDataFrame(rows, SCHEMA)))
    for df, columns in ((follows.edges_of, ["follower", "followee"]), (lambda x: x, ["follower", "followee", "left_at"])):
        assert sorted(map(str, df(got).select(*columns).collect())) == sorted(map(str, df(want).select(*columns).collect()))


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_long_lists_of_one_time_are_numbered_in_ranges(spark, ranges):
    """A loaded list: all edges have one time; repeated numbers are told apart by the member."""
    rng = random.Random(ranges)
    rows = [("star", f"m{i}", DAY, rng.randrange(50)) for i in range(300)]
    rows += [("other", f"m{i}", DAY, i) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame(rows, "username string, member string, since_ts timestamp_ntz, since_seq bigint")
        got = follows.numbered_in_ranges(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for user in ("star", "other"):
        mine = sorted((r.position, r.member) for r in got if r.username == user)
        want = [r[1] for r in sorted((x for x in rows if x[0] == user), key=lambda x: (x[3], x[1]))]
        assert mine == list(enumerate(want))


@pytest.mark.parametrize("size", [1, 2, 4, 10_000])
def test_lists_give_the_same_in_pages_of_any_size(spark, size):
    stored = {"u1": ["b", "c", "d", "e"], "u2": ["a", "c"], "u3": ["b"], "u4": []}
    rows = [
        (name, page, members[page * size : (page + 1) * size])
        for name, members in stored.items()
        for page in range(max(1, -(-len(members) // size)))
    ]
    pages = spark.createDataFrame(rows + [("u5", 0, None)], "username string, page bigint, members array<string>")

    def whole(df):
        found = {}
        for r in df.orderBy("page").collect():
            assert len(r.members) <= size
            found.setdefault(r.username, []).extend(r.members)
        return found

    def added(members):
        return members if "b" in members else [*members, "b"]

    want = {name: added(members) for name, members in stored.items()} | {"u5": ["b"]}
    assert whole(follows.add_to_lists(pages, "b", size)) == want
    gone = whole(follows.remove_from_lists(pages.where("members is not null"), "b"))
    assert gone == {name: [m for m in members if m != "b"] for name, members in stored.items()}
    held = follows.lists_contain(pages.withColumnRenamed("members", "following"), "b").collect()
    assert {r.username: r.following_them for r in held} == {
        name: "b" in members for name, members in stored.items()
    } | {"u5": False}
