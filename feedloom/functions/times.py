"""Date columns: parsing what clients send, and the two display formats."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(at: datetime) -> Column:
    """A TIMESTAMP_NTZ constant, the same in every session time zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_wall_clock(ts: Column) -> Column:
    """TIMESTAMP to the TIMESTAMP_NTZ that a UTC clock shows."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"
MONTH = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b"
# What is left of the accepted forms without the weekday.
PATTERNS = (
    "MMM d HH:mm:ss Z yyyy",
    "d MMM yyyy HH:mm:ss Z",
    "MMM d yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss",
    "MMM d yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "MMM d yyyy HH:mm",
    "d MMM yyyy",
    "MMM d yyyy",
)
# Clients' dates end 100 million days from the epoch, in milliseconds.
MAX_MILLIS = 8_640_000_000_000_000


def parse_created_at(raw: Column) -> Column:
    """The time that a client's text names, as TIMESTAMP; NULL where it names none.

    Accepted are ISO-8601 with a date, milliseconds since the epoch (five digits or more, but not eight),
    `Wed Aug 27 13:08:45 +0000 2008`, RFC 2822 (`Wed, 27 Aug 2008 13:08:45 GMT`), the display
    form, and dates like `Aug 27, 2008` or `27 August 2008`, with or without a time; days may have one digit.
    A time alone is refused: it would depend on the day of the
    run. So are eight digits: they may be meant as a date, `20080827`, or as milliseconds. The weekday is cut off before parsing: Spark parses no weekday names. Input without
    a zone is read in the zone of the session.
    """
    text = F.trim(raw)
    millis = F.when(text.rlike(r"^-?\d{5,16}$") & ~text.rlike(r"^\d{8}$"), text.try_cast("bigint"))
    millis = F.when(F.abs(millis) <= MAX_MILLIS, millis)
    iso = F.when(text.rlike(r"^\d{4}(-|$)"), F.try_to_timestamp(text))
    plain = F.regexp_replace(F.regexp_replace(text, WEEKDAY, ""), r"\s*\([^)]*\)$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, MONTH, "$1"), r",\s*", " ")
    plain = F.regexp_replace(plain, r"\b(GMT|UTC|UT)(?=[+-]\d{4})", "")
    plain = F.regexp_replace(plain, r"\b(GMT|UTC|UT|Z)$", "+0000")
    named = F.coalesce(*[F.try_to_timestamp(plain, F.lit(pattern)) for pattern in PATTERNS])
    # Trying all patterns is slow: only texts with the name of a month can match one.
    return F.coalesce(iso, F.timestamp_millis(millis), F.when(text.rlike(MONTH), named))


def display_time(ts: Column) -> Column:
    """`Wed Aug 27 2008 13:08:45 GMT+0000`."""
    return F.date_format(ts, "EEE MMM dd yyyy HH:mm:ss 'GMT+0000'")


def account_stamp(ts: Column) -> Column:
    """`August 27th 2008, 1:08:45 pm`."""
    day = F.dayofmonth(ts)
    suffix = (
        F.when(day.isin(11, 12, 13), "th")
        .when(day % 10 == 1, "st")
        .when(day % 10 == 2, "nd")
        .when(day % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(
        F.date_format(ts, "MMMM "),
        day.cast("string"),
        suffix,
        F.date_format(ts, " yyyy, h:mm:ss "),
        F.lower(F.date_format(ts, "a")),
    )
