"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

CORRUPT = "_corrupt"

# JSON-lines inputs
USER_LINE = StructType([
    StructField("username", StringType()),
    StructField("name", StringType()),
    StructField("followers", ArrayType(StringType())),
    StructField("following", ArrayType(StringType())),
])
TWEET_LINE = StructType([
    StructField("created_at", StringType()),
    StructField("text", StringType()),
    StructField("username", StringType()),
])

# Stored tables
USERS = StructType([
    StructField("username", StringType()),
    StructField("name", StringType()),
    StructField("pass", StringType()),
    StructField("date", StringType()),
])
TWEETS = StructType([
    StructField("tweet_id", LongType()),
    StructField("created_at", TimestampNTZType()),
    StructField("text", StringType()),
    StructField("username", StringType()),
    StructField("name", StringType()),
])
FOLLOW_EVENTS = StructType([
    StructField("follower", StringType()),
    StructField("followee", StringType()),
    StructField("action", StringType()),
    StructField("ts", TimestampNTZType()),
    StructField("seq", LongType()),
])
POSTS = StructType([
    StructField("tweet_id", LongType()),
    StructField("created_at", TimestampNTZType()),
    StructField("text", StringType()),
    StructField("username", StringType()),
])
SIGN_UPS = StructType([
    StructField("request_id", LongType()),
    StructField("username", StringType()),
    StructField("name", StringType()),
])

# Streams
MOMENT = StructType([
    StructField("ts", TimestampNTZType()),
    StructField("seq", LongType()),
])
FOLLOW_RECORDS = StructType([
    StructField("follower", StringType()),
    StructField("followee", StringType()),
    StructField("left_at", MOMENT),
    StructField("since", MOMENT),
    StructField("followed_at", MOMENT),
])
READ_UP_TO = StructType([
    StructField("writer", StringType()),
    StructField("batch", LongType()),
])
PROGRESS = StructType([
    StructField("stream", StringType()),
    StructField("batch", LongType()),
    StructField("rows", LongType()),
    StructField("dropped", LongType()),
    StructField("state_rows", LongType()),
    StructField("watermark", StringType()),
])
