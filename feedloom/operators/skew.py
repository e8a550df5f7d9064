"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most MAX_HOT_KEYS keys can each hold more than 1/MAX_HOT_KEYS of the rows, so
# a frame of hot keys is always small enough to broadcast. Joins that adaptive execution can split are
# written as plain joins; this is for windows, written buckets and sessions without it.
MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 1_000_000
# A hot key is split into sub-keys of about this many rows.
ROWS_PER_SALT = 1_000_000
NULL_SALTS = 1 << 16
HASH_BITS = 16


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    max_keys: int = MAX_HOT_KEYS,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Non-null keys with at least `min_rows` rows and over 1/`max_keys` of all rows,
    and their row count `_n`.

    Counts by a hash of the key first, which bounds what a task sends to the shuffle;
    a hot key makes its hash hot, so keys are counted only within hot hashes, of
    which there are at most `max_keys` too. Usually there are none, and AQE drops
    the second count.
    """
    rows = df.select(*keys).na.drop()
    hashed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*keys), 64 - HASH_BITS))

    def count_by(frame: DataFrame, *columns: str) -> DataFrame:
        return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))

    by_hash = count_by(hashed, "_h")
    total = by_hash.agg(F.sum("_n")).scalar()
    many = (F.col("_n") >= min_rows) & (F.col("_n") * max_keys > total)
    hot_hashes = F.broadcast(by_hash.where(many).select("_h"))
    candidates = hashed.join(hot_hashes, "_h", "left_semi")
    return count_by(candidates, *keys).where(many)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    salt_by: Sequence[str],
    hot: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner, left, semi or anti join of a skewed `left` with a `right` of few rows per key.

    The rows of a hot key are spread over as many sub-keys as its size asks for, by a
    hash of the `salt_by` columns, which must tell rows of one key apart. Only the right
    rows of hot keys are copied, once per sub-key. Rows with a NULL key match nothing
    and are spread as well. A hash, unlike a random number, is the same when a task
    runs again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salted_join keeps to inner, left, semi and anti joins")
    if hot is None:
        hot = hot_keys(left, keys)
    # Some of the keys may be enough to tell hot ones.
    by = [c for c in hot.columns if c != "_n"]
    salts = F.ceil(F.col("_n") / rows_per_salt).cast("bigint")
    marked = F.broadcast(hot.select(*by, salts.alias("_salts")))
    row_hash = F.xxhash64(*salt_by)
    null_key: Column = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    salt = F.when(null_key, row_hash.bitwiseAND(NULL_SALTS - 1)).otherwise(
        F.coalesce(F.pmod(row_hash, F.col("_salts")), F.lit(0))
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)
    salted_left = (
        left.join(marked, by, "left").withColumn("_salt", salt).drop("_salts")
    )
    salted_right = (
        right.join(marked, by, "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
