from datetime import datetime

from pyspark.sql import functions as F

from feedloom.functions.times import wall_clock
from feedloom.operators import accounts
from feedloom.sinks.tables import append_table, replace_table

AT = datetime(2014, 11, 23, 14, 5, 9)
USERS = "username string, name string"


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, i int")
    rows = accounts.first_per_key(df, "k", [F.col("i")]).collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 3)]


def test_sign_up_appends_only_new_names(spark, tmp_path):
    path = str(tmp_path / "users")
    start = spark.createDataFrame([("a", "Ann")], USERS)
    replace_table(accounts.with_credentials(start, wall_clock(AT)), path)
    requests = spark.createDataFrame(
        [(1, "b", "Bob"), (2, "a", "Other"), (3, "b", "Third")],
        "request_id bigint, username string, name string",
    )
    outcomes = accounts.sign_up_outcomes(requests, spark.read.parquet(path))
    got = {r.request_id: r.outcome for r in outcomes.collect()}
    assert got == {1: "created", 2: "username-taken", 3: "username-taken"}
    append_table(accounts.new_accounts(outcomes, wall_clock(AT)), path)
    users = spark.read.parquet(path)
    assert {r.username: r.name for r in users.collect()} == {"a": "Ann", "b": "Bob"}


def test_attempts_and_default_passwords(spark):
    users = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], USERS)
    stored = accounts.with_credentials(users, wall_clock(AT)).withColumn(
        "pass",
        F.when(F.col("username") == "b", F.lit("0123456789" + "0" * 32)).otherwise(F.col("pass")),
    )
    attempts = spark.createDataFrame(
        [(1, "a", "a"), (2, "a", "x"), (3, "c", "c"), (4, "b", "b")],
        "attempt_id int, username string, password string",
    )
    got = accounts.attempt_outcomes(attempts, stored).orderBy("attempt_id")
    assert [r.outcome for r in got.collect()] == [
        "ok", "invalid-password", "user-not-found", "invalid-password"]
    assert [r.username for r in accounts.default_passwords(stored).collect()] == ["a"]


def test_salt_column(spark):
    users = spark.createDataFrame([("a", "Ann", "zyxwvutsrq")], USERS + ", salt string")
    row = accounts.with_credentials(users, wall_clock(AT), F.col("salt")).first()
    assert row["pass"].startswith("zyxwvutsrq") and len(row["pass"]) == 42
