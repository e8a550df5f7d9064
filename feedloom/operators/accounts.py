"""Account rows: first per username, accounts not taken yet, attempt outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.credentials import attempt_outcome, default_salt, salted_hash
from feedloom.functions.times import account_stamp
from feedloom.operators.topk import top_k_per_group


CREATED, TAKEN = "created", "username-taken"


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given (total) order."""
    return top_k_per_group(df, [key], order, k=1, rank="_rk").drop("_rk")


def not_taken(new_users: DataFrame, existing: DataFrame) -> DataFrame:
    """New users (one row per username) whose username no stored user has."""
    return new_users.join(existing.select("username"), "username", "left_anti")


def with_credentials(users: DataFrame, created: Column, salt: Column | None = None) -> DataFrame:
    """Adds `pass` (initial password = username) and the creation stamp `date`."""
    name = F.col("username")
    return users.withColumns(
        {
            "pass": salted_hash(name, default_salt(name) if salt is None else salt),
            "date": account_stamp(created),
        }
    )


def sign_up_outcomes(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests(request_id, username, ...)` with `outcome`: the first request for a
    username that no stored user has is "created", all others are "username-taken"."""
    first = first_per_key(
        requests.select("username", "request_id"), "username", [F.col("request_id")]
    )
    created = not_taken(first, existing).select("request_id", F.lit(True).alias("_created"))
    return requests.join(created, "request_id", "left").withColumn(
        "outcome", F.when(F.col("_created"), CREATED).otherwise(TAKEN)
    ).drop("_created")


def new_accounts(outcomes: DataFrame, at: Column, salt: Column | None = None) -> DataFrame:
    """Rows to append to the users table for the requests that were accepted."""
    accepted = outcomes.where(F.col("outcome") == CREATED).select("username", "name")
    return with_credentials(accepted, at, salt)


def attempt_outcomes(attempts: DataFrame, accounts: DataFrame) -> DataFrame:
    """`attempts(username, password, ...)` with a column `outcome`.

    The attempts are read once; adaptive execution splits those on a name that is tried very often.
    """
    stored = accounts.select("username", F.col("pass").alias("_stored"))
    return (
        attempts.join(stored, "username", "left")
        .withColumn("outcome", attempt_outcome(F.col("password"), F.col("_stored")))
        .drop("_stored")
    )


def default_passwords(accounts: DataFrame) -> DataFrame:
    """Accounts whose password still is the username. No join: one row has it all."""
    outcome = attempt_outcome(F.col("username"), F.col("pass"))
    return accounts.where(outcome == "ok").select("username")
