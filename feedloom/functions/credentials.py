"""Stored-credential columns, for compatibility and audits only.

MD5 with a 10-character salt is what the stored tables hold. Do not
authenticate anyone with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stored format.
SALT_LENGTH = 10
OUTCOME_UNKNOWN = "user-not-found"
OUTCOME_WRONG = "invalid-password"
OUTCOME_OK = "ok"


def default_salt(username: Column) -> Column:
    """A salt that is the same when a task runs again."""
    return F.substring(F.md5(username), 1, SALT_LENGTH)


def salted_hash(password: Column, salt: Column) -> Column:
    return F.concat(salt, F.md5(F.concat(password, salt)))


def password_matches(password: Column, stored: Column) -> Column:
    return salted_hash(password, F.substring(stored, 1, SALT_LENGTH)) == stored


def attempt_outcome(password: Column, stored: Column) -> Column:
    return (
        F.when(stored.isNull(), OUTCOME_UNKNOWN)
        .when(password_matches(password, stored), OUTCOME_OK)
        .otherwise(OUTCOME_WRONG)
    )
