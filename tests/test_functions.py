import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import credentials, lists, text, times
from feedloom.plans import trending

TEXTS = [
    ("a  #b x#y # #Up! ", ["#b", "#", "#Up!"]),
    ("#a #A #a", ["#a", "#A", "#a"]),
    ("#a\n#b", ["#a\n#b"]),
    ("#a\t#b", ["#a\t#b"]),
    ("", []),
    (None, []),
]


def test_hashtags(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "tweet_id bigint, text string")
    found = {i: [] for i, _ in rows}
    for r in trending.hashtag_tokens(df).orderBy("tweet_id", "pos").collect():
        found[r.tweet_id].append(r.tag)
    assert found == {i: tags for i, (_, tags) in enumerate(TEXTS)}


def test_text_problem(spark):
    cases = [(None, "empty"), ("", "empty"), ("x" * 140, None), ("ü" * 141, "too_long")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    got = [r[0] for r in df.select(text.text_problem(F.col("text"))).collect()]
    assert got == [p for _, p in cases]


def test_parse_created_at(spark):
    cases = [
        ("2014-11-23T14:05:09.123Z", datetime(2014, 11, 23, 14, 5, 9, 123000)),
        ("2014-11-23T14:05:09+02:00", datetime(2014, 11, 23, 12, 5, 9)),
        ("Wed Aug 27 13:08:45 +0000 2008", datetime(2008, 8, 27, 13, 8, 45)),
        ("Wed Aug 7 13:08:45 +0000 2013", datetime(2013, 8, 7, 13, 8, 45)),
        ("Wed, 27 Aug 2008 13:08:45 GMT", datetime(2008, 8, 27, 13, 8, 45)),
        ("Wed, 7 Aug 2013 13:08:45 +0200", datetime(2013, 8, 7, 11, 8, 45)),
        ("27 Aug 2008 13:08:45 -0000", datetime(2008, 8, 27, 13, 8, 45)),
        ("Wed Aug 27 2008 13:08:45 GMT+0000", datetime(2008, 8, 27, 13, 8, 45)),
        ("Wed Aug 27 2008 15:08:45 GMT+0200 (CEST)", datetime(2008, 8, 27, 13, 8, 45)),
        ("1219842525000", datetime(2008, 8, 27, 13, 8, 45)),
        ("20080827", None),
        ("Aug 27, 2008", datetime(2008, 8, 27)),
        ("August 7, 2008", datetime(2008, 8, 7)),
        ("27 Aug 2008", datetime(2008, 8, 27)),
        ("Wed, 27 August 2008", datetime(2008, 8, 27)),
        ("Aug 27, 2008 13:08:45", datetime(2008, 8, 27, 13, 8, 45)),
        ("27 Aug 2008 13:08", datetime(2008, 8, 27, 13, 8)),
        ("May 1 2008", datetime(2008, 5, 1)),
        ("Augment 27, 2008 x", None),
        ("8640000000000001", None),
        ("99999999999999999999", None),
        ("2008-08-27", datetime(2008, 8, 27)),
        ("10:00:00", None),
        ("T10:00", None),
        ("nope", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    parsed = times.utc_wall_clock(times.parse_created_at(F.col("c")))
    assert [r[0] for r in df.select(parsed).collect()] == [e for _, e in cases]


def test_parse_created_at_gives_utc_in_other_zones(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("Wed Aug 27 13:08:45 +0000 2008",)], "c string")
        parsed = times.utc_wall_clock(times.parse_created_at(F.col("c")))
        assert df.select(parsed).first()[0] == datetime(2008, 8, 27, 13, 8, 45)
        assert df.select(times.wall_clock(datetime(2008, 8, 27, 1))).first()[0] == datetime(
            2008, 8, 27, 1
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_display_time(spark):
    df = spark.range(1).select(times.wall_clock(datetime(2008, 8, 27, 13, 8, 45)).alias("t"))
    assert df.select(times.display_time(F.col("t"))).first()[0] == (
        "Wed Aug 27 2008 13:08:45 GMT+0000"
    )


@pytest.mark.parametrize(
    "day, shown",
    [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"),
     (13, "13th"), (21, "21st"), (22, "22nd"), (23, "23rd"), (30, "30th"), (31, "31st")],
)
def test_account_stamp(spark, day, shown):
    at = times.wall_clock(datetime(2008, 8, day, 13, 8, 45))
    row = spark.range(1).select(times.account_stamp(at)).first()
    assert row[0] == f"August {shown} 2008, 1:08:45 pm"


def test_midnight_stamp(spark):
    at = times.wall_clock(datetime(2008, 8, 1, 0, 5, 9))
    assert spark.range(1).select(times.account_stamp(at)).first()[0] == (
        "August 1st 2008, 12:05:09 am"
    )


def test_salted_hash(spark):
    row = spark.range(1).select(
        credentials.salted_hash(F.lit("pw"), F.lit("0123456789"))
    ).first()
    assert row[0] == "0123456789" + hashlib.md5(b"pw0123456789").hexdigest()


def test_attempt_outcomes(spark):
    stored = credentials.salted_hash(F.lit("pw"), F.lit("0123456789"))
    cases = [("pw", True, "ok"), ("no", True, "invalid-password"), ("pw", False, "user-not-found"),
             (None, True, "invalid-password")]
    df = spark.createDataFrame([(p, s) for p, s, _ in cases], "password string, known boolean")
    df = df.withColumn("stored", F.when(F.col("known"), stored))
    got = df.select(credentials.attempt_outcome(F.col("password"), F.col("stored")))
    assert [r[0] for r in got.collect()] == [e for _, _, e in cases]


def test_report_text(spark):
    rows = [(1, 1, "#a", 5), (1, 2, "#a2", 3), (1, 3, "#b", 3)]
    df = spark.createDataFrame(rows, "window_end int, rk bigint, tag string, cnt bigint")
    assert trending.report_text(df).first().report == (
        "\nTop 10 hashtags:\n(5,#a)\n(3,#a2)\n(3,#b)\n"
    )


def test_list_updates(spark):
    cases = [(["a"], ["a", "b"], ["a"]), (["b", "a", "b"], ["b", "a", "b"], ["a"]),
             ([], ["b"], []), (None, ["b"], None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<string>")
    got = df.orderBy("i").select(
        lists.add_if_absent(F.col("l"), F.lit("b")), lists.remove(F.col("l"), F.lit("b"))
    )
    assert [tuple(r) for r in got.collect()] == [c[1:] for c in cases]
