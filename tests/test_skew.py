import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [("hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "x", None]), i) for i in range(900)]
    right = [("hot", 1), ("hot", 2), ("a", 3), ("b", 4), ("unused", 5), (None, 6)]
    return (
        spark.createDataFrame(left, "k string, i bigint"),
        spark.createDataFrame(right, "k string, v bigint"),
    )


def test_hot_keys_are_the_large_ones(sides):
    left, _ = sides
    assert [r.k for r in hot_keys(left, ["k"], min_rows=200).collect()] == ["hot"]
    assert hot_keys(left, ["k"]).count() == 0


def test_hot_keys_are_few_by_construction(spark):
    df = spark.range(10_000).select((F.col("id") % 1000).alias("k"))
    assert hot_keys(df, ["k"], max_keys=100, min_rows=1).count() == 0
    assert hot_keys(df, ["k"], max_keys=1001, min_rows=1).count() == 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 200])
def test_salted_join_equals_join(sides, how, min_rows):
    left, right = sides
    hot = hot_keys(left, ["k"], min_rows=min_rows)
    got = salted_join(left, right, ["k"], how, ["i"], hot=hot, rows_per_salt=30)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_spread(sides, spark):
    left, right = sides
    hot = hot_keys(left, ["k"], min_rows=200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, ["k"], "inner", ["i"], hot=hot, rows_per_salt=10)
        parts = (
            joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) > 4


def test_full_join_is_refused(sides):
    with pytest.raises(ValueError):
        salted_join(*sides, ["k"], "full", ["i"])
