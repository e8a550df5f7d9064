"""Feed tables derived from the benchmark tables (events, orders, customer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.times import display_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def username(user_id) -> Column:
    return F.concat(F.lit("user"), user_id.cast("string"))


def tweet_text() -> Column:
    """Text with a double space, inner and bare `#`, case, punctuation, a last space."""
    return F.concat(
        F.lit("now  #"),
        F.col("event_type"),
        F.lit(" x#y #k"),
        F.get_json_object("props", "$.k"),
        F.lit(" # #Up! "),
    )


def tweet_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("tweet_id"),
        username(F.col("user_id")).alias("username"),
        F.col("ts").alias("created_at"),
        tweet_text().alias("text"),
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tweet_columns(table(spark, sf_dir, "events"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who posted."""
    posting = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return (
        table(spark, sf_dir, "customer")
        .join(posting, "c_custkey", "left_semi")
        .select(username(F.col("c_custkey")).alias("username"), F.col("c_name").alias("name"))
    )


def user_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of posting users, as a scalar subquery."""
    return table(spark, sf_dir, "events").agg(F.max("user_id") + 1).scalar()


def follow_columns(orders: DataFrame, n: Column) -> DataFrame:
    """One follow or unfollow per order, among n users."""
    follower = F.col("o_custkey") % n
    followee = (F.pmod(F.col("o_orderkey") * 7 + 3, F.lit(23)) + follower) % n
    return orders.select(
        username(follower).alias("follower"),
        username(followee).alias("followee"),
        F.when(F.col("o_orderstatus") == "P", "unfollow").otherwise("follow").alias("action"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )


def follow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follow_columns(table(spark, sf_dir, "orders"), user_count(spark, sf_dir))


def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per order; some names are unknown, some passwords wrong."""
    n = user_count(spark, sf_dir)
    name = username(F.col("o_custkey") % (2 * n))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"),
        name.alias("username"),
        F.when(F.col("o_orderstatus") == "F", name)
        .otherwise(F.col("o_orderpriority"))
        .alias("password"),
    )


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: its user looks at another user's profile."""
    n = user_count(spark, sf_dir)
    step = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        username(F.col("user_id")).alias("viewer"),
        username((F.col("user_id") + step) % n).alias("profile"),
    )


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of the bulk load, one frame row per line: `value, key, part`.

    Every customer has a line; BUILDING ones have a second with another name,
    MACHINERY ones a broken second line, FURNITURE ones no arrays.
    """
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    arrays = segment != "FURNITURE"

    def line(name: Column) -> Column:
        return F.to_json(
            F.struct(
                username(key).alias("username"),
                name.alias("name"),
                F.when(arrays, F.array(username(key + 2))).alias("followers"),
                F.when(
                    arrays, F.array(username(key + 1), username(key + 3), username(key + 1))
                ).alias("following"),
            )
        )

    first = line(F.col("c_name"))
    lines = F.filter(
        F.array(
            first,
            F.when(segment == "BUILDING", line(F.concat(F.lit("Other "), "c_name"))),
            F.when(segment == "MACHINERY", F.concat(F.lit("{bad "), "c_name")),
        ),
        lambda x: x.isNotNull(),
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("key"), F.posexplode(lines).alias("part", "value")
    )


def tweet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of tweets with two date formats, and no date for errors."""
    created = (
        F.when(
            F.col("event_type") == "view",
            F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy"),
        )
        .when(F.col("event_type") == "error", "nope")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    line = F.struct(
        created.alias("created_at"),
        tweet_text().alias("text"),
        username(F.col("user_id")).alias("username"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), F.lit(0).alias("part"), F.to_json(line).alias("value")
    )


def date_form(number: str, ts: str) -> Column:
    """`ts` as a text in one of twelve forms, by `number`; three of them name no date, two only the day."""
    forms = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.date_format(ts, "EEE MMM d HH:mm:ss '+0000' yyyy"),
        F.unix_millis(F.col(ts).cast("timestamp")).cast("string"),
        F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0000'"),
        display_time(F.col(ts)),
        F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        F.date_format(ts, "HH:mm:ss"),
        F.date_format(ts, "'T'HH:mm"),
        F.date_format(ts, "yyyyMMdd"),
        F.date_format(ts, "MMMM d, yyyy"),
        F.date_format(ts, "EEE, d MMM yyyy"),
        F.date_format(ts, "MMM d, yyyy HH:mm:ss"),
    ]
    return F.element_at(F.array(*forms), (F.pmod(F.col(number), F.lit(len(forms))) + 1).cast("int"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines as text in (key, part) order over many files."""
    (
        lines.repartitionByRange("key", "part")
        .sortWithinPartitions("key", "part")
        .select("value")
        .write.text(path)
    )
