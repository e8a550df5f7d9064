"""Exact dedup against a history, through a minimal perfect hash of its digests.

The index is a table of buckets. A bucket holds a few thousand distinct SHA-256 digests: a
cascade of bit arrays (each key is in the first level where no other key has its bit; its
slot is the number of set bits before its own) and, by slot, the full digest, the winner's
id and the number of rows. A perfect hash gives any digest some slot, so a lookup
compares all 32 bytes with what the slot holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage

DIGEST_BYTES = 32
KEYS_PER_BUCKET = 4096
# Stands for "no id" inside, so that every real id is smaller.
NO_ID = 2**63 - 1
INDEX_SCHEMA = (
    "bucket long, sizes array<int>, bits binary, digests binary, "
    "winners array<long>, counts array<long>"
)
LOOKUP_SCHEMA = "digest binary, first_id long, n long, winner long, history_n long"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key (rows of two 64-bit words) in a level."""
    mixed = keys[:, 0] + np.uint64(level) * (keys[:, 1] | np.uint64(1))
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(size)).astype(np.int64)


def _words(digests: np.ndarray) -> np.ndarray:
    """The two words of a digest that choose its bits; the bucket uses other bytes."""
    return np.ascontiguousarray(digests[:, 8:24]).view(np.uint64)


def build_bits(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the bits of all levels for distinct digests (n rows of 32 bytes)."""
    left, sizes, levels = _words(digests), [], []
    while len(left):
        size = len(left) + len(left) // 2 + 1
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    words = _words(digests)
    slots = np.full(len(digests), -1, np.int64)
    start = 0
    for level, size in enumerate(sizes):
        open_rows = np.flatnonzero(slots < 0)
        at = _positions(words[open_rows], level, size) + start
        found = bits[at]
        slots[open_rows[found]] = rank[at[found]]
        start += size
    return slots


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST_BYTES)


def _build(groups: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(groups["digest"])
    sizes, bits = build_bits(keys)
    order = np.empty(len(keys), np.int64)
    order[slots_of(keys, sizes, bits)] = np.arange(len(keys))
    return pd.DataFrame(
        {
            "bucket": [int(groups["bucket"].iloc[0])],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [keys[order].tobytes()],
            "winners": [groups["first_id"].to_numpy()[order].tolist()],
            "counts": [groups["n"].to_numpy()[order].tolist()],
        }
    )


def _look_up(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    out = asked[["digest", "first_id", "n"]]
    winner = np.full(len(asked), NO_ID, np.int64)
    count = np.zeros(len(asked), np.int64)
    if len(index) and len(asked):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
        total = int(sum(row["sizes"]))
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:total].astype(bool)
        keys = _matrix(asked["digest"])
        slots = slots_of(keys, list(row["sizes"]), bits)
        # All bytes decide: a digest that isn't a member gets a slot too.
        hit = np.flatnonzero((slots >= 0) & (held[slots] == keys).all(axis=1))
        winner[hit] = np.asarray(row["winners"], np.int64)[slots[hit]]
        count[hit] = np.asarray(row["counts"], np.int64)[slots[hit]]
    return out.assign(winner=winner, history_n=count)


def grouped(digests: DataFrame) -> DataFrame:
    """Rows and smallest id per digest; copies meet on the map side first."""
    first = F.min(F.coalesce("doc_id", F.lit(NO_ID)))
    return digests.groupBy("digest").agg(first.alias("first_id"), F.count(F.lit(1)).alias("n"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index of history groups (digest, first_id, n), one row per bucket."""
    dealt = groups.withColumn("bucket", _bucket(buckets))
    return dealt.groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def look_up(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """Adds winner and history_n to groups of new digests; history_n is 0 for nonmembers."""
    dealt = groups.withColumn("bucket", _bucket(buckets))
    return (
        index.groupBy("bucket")
        .cogroup(dealt.groupBy("bucket"))
        .applyInPandas(_look_up, LOOKUP_SCHEMA)
    )


def dedup(history: DataFrame, incoming: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Group of every row of `history` and `incoming`, by normalised text.

    Both need doc_id (a long) and text; other columns are left out. Returns doc_id, keep_id,
    group_size, kept, text_sha256 for each row, dropped ones too. Of equal texts, the
    smallest doc_id stays. Null and empty texts form one group. A null id stays only in a
    group without any other id, whose keep_id is then null. Rows repeated under the id that stays are all
    marked kept, and each counts in group_size. Empty tables give no rows.

    Only digests are shuffled, and only distinct ones per task; a group's size doesn't matter
    until its rows are joined with the group's result, where Spark splits large keys.
    """
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    columns = [doc_id, digest_of(F.col("text")).alias("digest")]
    both = history.select(*columns, F.lit(True).alias("old")).unionByName(
        incoming.select(*columns, F.lit(False).alias("old"))
    )
    rows = stage(both, "digests")
    old = stage(grouped(rows.where("old")), "history")
    new = stage(grouped(rows.where("NOT old")), "incoming")
    # A bucket's digests of either side meet in one task.
    buckets = max(old.count(), new.count()) // keys_per_bucket + 1
    index = stage(build_index(old, buckets), "digest-index")
    asked = stage(look_up(index, new, buckets), "lookups")
    repeats = asked.where("history_n > 0").select("digest", "first_id", "n")
    members = old.unionByName(repeats).groupBy("digest").agg(
        F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    others = asked.where("history_n = 0").select(
        "digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")
    )
    keep_id = F.nullif("keep_id", F.lit(NO_ID))
    return rows.join(members.unionByName(others), "digest").select(
        "doc_id",
        keep_id.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and incoming rows of one table: the lower half of the range of ids came
    first. Rows without an id are incoming."""
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if ends[0] is None else (ends[0] + ends[1]) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return docs.where(old), docs.where(~old)

