"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stage

# A shard's rows are numbered in chunks of about this many.
CHUNK_ROWS = 200_000
HEX_DIGITS = 13
# Bytes that a record takes besides its text.
OVERHEAD = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for `key`.

    Shard s scores `weight / -ln(u)`, where u in (0, 1) comes from the first 13 hex digits
    of md5("s:key"). The scores of the other shards don't change when one is added or its
    weight is raised, so rows only move into that shard. Equal scores go to the higher
    shard number. A null key counts as the text "null".
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def scored(weight: Column, shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(shard.cast("string"), F.lit(":"), name)), 1, HEX_DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
        return F.struct((weight / -F.ln(u)).alias("score"), shard.alias("shard"))

    return F.array_max(F.transform(shares, scored))["shard"]


def shard_records(
    records: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Shard and slot of every record.

    Returns the key column, size, text_crc32, law, shard, slot, and grown_shard (the shard
    under `grown_weights`, null without them). The key and the weights alone decide the
    shard: records with one key share it, and so do all records with a null key. Slots of a shard
    run from 0 without a gap. Repeated rows get a slot each. A null text has no bytes. Other
    columns of the input are left out. An empty table gives an empty result.

    No shard is numbered in one task: equal rows are counted, what is left is dealt into chunks by hash, chunks are
    counted, and a row's slot is its number in the chunk plus the rows of earlier chunks. Equal rows
    take slots in a row, made by as many tasks as they fill chunks.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    grown = rendezvous(F.col(key), grown_weights) if grown_weights else F.lit(None)
    placed = stage(
        records.select(
            F.col(key).alias("key"),
            (F.octet_length(content) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(content).alias("text_crc32"),
            rendezvous(F.col(key), weights).alias("shard"),
            grown.cast("int").alias("grown_shard"),
        ),
        "shards",
    )
    chunks = max(8, placed.count() // (len(weights) * chunk_rows) + 1)
    record = ["key", "text_crc32", "size"]
    # Equal rows are counted, and given their slots in the end.
    rows = (
        placed.groupBy(*record, "shard", "grown_shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("chunk", F.pmod(F.xxhash64(*record), F.lit(chunks)))
    )
    so_far = Window.unboundedPreceding, -1
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(*so_far)
    starts = (
        rows.groupBy("shard", "chunk")
        .agg(F.sum("n").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "chunk").orderBy(*record).rowsBetween(*so_far)
    numbered = (
        rows.withColumn("number", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, ["shard", "chunk"])
        .withColumn("first", F.col("start") + F.col("number"))
    )

    def copies(first: str, n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias(first)

    few = numbered.where(F.col("n") <= chunk_rows).select("*", copies("copy", "n"))
    # Very many equal rows are made by many tasks, each of a part of them.
    parts = F.ceil(F.col("n") / chunk_rows).cast("bigint")
    many = (
        numbered.where(F.col("n") > chunk_rows)
        .withColumn("parts", parts)
        .select("*", copies("part", "parts"))
        .repartition(*record, "part")
        .withColumn("left", F.least(F.lit(chunk_rows), F.col("n") - F.col("part") * chunk_rows))
        .select("*", copies("within", "left"))
        .withColumn("copy", F.col("part") * chunk_rows + F.col("within"))
    )
    return few.unionByName(many.select(few.columns)).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("copy")).alias("slot"),
        "grown_shard",
    )
