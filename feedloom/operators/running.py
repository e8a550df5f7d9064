"""The k smallest values up to a place, for any number of places, by a scan over a tree of blocks.

Places are whole numbers. A block of places has its k smallest values, a block of blocks those of its
blocks, and so on. What lies before a place is then the blocks before its own block in each larger
one: a few lists of k values. Every step is a group of at most FAN lists, so nothing passes through
one task but the few lists of the largest blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.topk import top_k_per_group

FAN = 64


def levels_for(places: int, fan: int = FAN) -> int:
    """Steps of a tree over so many places."""
    return max(1, math.ceil(math.log(max(places, 2), fan)))


def smallest_of(lists: Column, k: int) -> Column:
    """The k smallest of an array of arrays of different values."""
    return F.slice(F.array_sort(F.flatten(lists)), 1, k)


def smallest_until(
    values: DataFrame, requests: DataFrame, value: str, k: int, places: int, out: str, fan: int = FAN
) -> DataFrame:
    """`requests` (place, ...) with array `out`: the k smallest of `values` (place, value) at or before the place.

    Values must differ, and places be from 0 to `places` - 1. `values` is read once a level, so write it before.
    """
    least = top_k_per_group(values.select("place", value), ["place"], [F.asc(value)], k)
    nodes = least.groupBy(F.col("place").alias("node")).agg(F.collect_list(value).alias("names"))
    found, lists = requests, []
    for level in range(levels_for(places, fan)):
        child = F.pmod("node", F.lit(fan))
        blocks = (
            nodes.select(F.floor(F.col("node") / fan).alias("block"), F.struct(child.alias("child"), "names").alias("kid"))
            .groupBy("block")
            .agg(F.collect_list("kid").alias("kids"))
        )
        name = f"names_{level}"
        # At the lowest level, the place itself counts too.
        upto = F.col("child") + (1 if level == 0 else 0)
        earlier = F.filter("kids", lambda kid: kid["child"] < upto)["names"]
        before = blocks.select(
            "block", "kids", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("child")
        ).select((F.col("block") * fan + F.col("child")).alias("node"), smallest_of(earlier, k).alias(name))
        found = found.withColumn("node", F.floor(F.col("place") / fan**level)).join(before, "node", "left")
        lists.append(F.coalesce(F.col(name), F.array().cast(before.schema[name].dataType)))
        nodes = blocks.select(F.col("block").alias("node"), smallest_of(F.col("kids")["names"], k).alias("names"))
    every = smallest_of(F.array(*lists), k)
    return found.select(*requests.columns, every.alias(out))
