"""Updates of one stored list as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_if_absent(members: Column, name: Column) -> Column:
    """`name` at the end of the list unless it is in it; a missing list starts here."""
    known = F.coalesce(members, F.array().cast("array<string>"))
    return F.when(F.array_contains(known, name), known).otherwise(F.array_append(known, name))


def remove(members: Column, name: Column) -> Column:
    """The list without any `name`."""
    return F.array_remove(members, name)
