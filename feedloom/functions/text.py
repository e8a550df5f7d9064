"""Text columns: hashtags, length rule, ranking lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feed: tag prefix, word separator, longest text, report header.
TAG_PREFIX = "#"
WORD_SEPARATOR = " "
MAX_TEXT_LENGTH = 140
REPORT_HEADER = "\nTop 10 hashtags:\n"


def words(text: Column) -> Column:
    """Words between single spaces; tabs and newlines do not separate."""
    return F.split(text, WORD_SEPARATOR)


def is_hashtag(word: Column) -> Column:
    return word.startswith(TAG_PREFIX)


def text_problem(text: Column) -> Column:
    """Why a text is not postable, or NULL if it is."""
    return (
        F.when(text.isNull() | (text == ""), F.lit("empty"))
        .when(F.char_length(text) > MAX_TEXT_LENGTH, F.lit("too_long"))
    )


def ranking_line(cnt: Column, tag: Column) -> Column:
    return F.concat(F.lit("("), cnt.cast("string"), F.lit(","), tag, F.lit(")\n"))
