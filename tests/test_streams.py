import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.jobs import trending as trending_job
from feedloom.operators.follows import fold_follow_events
from feedloom.plans import trending
from feedloom.schemas import FOLLOW_EVENTS, POSTS, SIGN_UPS, TWEETS
from feedloom.sinks.tables import append_batch, append_table, replace_batches, replace_table
from feedloom.sinks.topic import topic_records
from feedloom.sources.tables import read_batches, table_stream
from feedloom.sources.topic import message_posts, message_texts, topic_stream
from feedloom.sinks.versions import Folder, Versions
from feedloom.streaming.follows import compact, follow_stream, followed_edges, followed_pairs
from feedloom.streaming.posts import post_stream, to_table
from feedloom.streaming.progress import ProgressTable, watermark_of
from feedloom.streaming.sign_ups import sign_up_stream
from feedloom.streaming.trending import drain, late_rows, trending_stream, use_rocksdb

START = datetime(2024, 1, 1, 12)
ONCE = {"availableNow": True}


def posts(seed=0, n=60):
    rng = random.Random(seed)
    times = sorted(rng.randrange(2400) for _ in range(n))
    return [(i, START + timedelta(seconds=s), f"#a{rng.randrange(14)} x #b", f"u{i % 5}")
            for i, s in enumerate(times)]


def add_file(spark, folder, name, rows, schema):
    """One new file of a table folder; names sort in the order of their writing."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def files(spark, folder, schema):
    return table_stream(spark, f"{folder}/*", schema, max_files_per_trigger=1)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def ranking(spark, path):
    df = spark.read.parquet(path).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
    return rows_of(df, "window_end", "rk", "tag", "cnt")


def run_trending(spark, folder, out, **options):
    messages = files(spark, folder, POSTS).select(F.col("created_at").alias("ts"), "text")
    query = trending_stream(
        messages, f"{out}/table", f"{out}/checkpoint", trigger=ONCE, reports=f"{out}/reports", **options
    )
    query.awaitTermination()
    return query


def expected(spark, rows, until):
    df = trending.trending(spark.createDataFrame(rows, POSTS))
    return rows_of(df.where(F.col("window_end") <= until), "window_end", "rk", "tag", "cnt")


@pytest.mark.parametrize("rocksdb", [False, True])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, rocksdb):
    rows, folder, out = posts(), str(tmp_path / "in"), str(tmp_path / "out")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if rocksdb:
        use_rocksdb(spark)
    try:
        for i, part in enumerate((rows[:20], rows[20:40])):
            add_file(spark, folder, f"{i}", part, POSTS)
        run_trending(spark, folder, out, delay="0 seconds")
        assert ranking(spark, f"{out}/table") == expected(spark, rows[:40], rows[39][1])
        add_file(spark, folder, "2", rows[40:], POSTS)
        run_trending(spark, folder, out, delay="0 seconds")
        assert ranking(spark, f"{out}/table") == expected(spark, rows, rows[-1][1])
    finally:
        spark.conf.set(key, before)
    reports = spark.read.parquet(f"{out}/reports")
    assert reports.count() == reports.select("window_end").distinct().count() > 20
    assert reports.first().report.startswith("\nTop 10 hashtags:\n(")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows, folder, out = posts(), str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, folder, "0", rows, POSTS)
    run_trending(spark, folder, out, delay="2 minutes")
    late = [(99, START - timedelta(hours=1), "#late", "u1")]
    add_file(spark, folder, "1", late, POSTS)
    query = run_trending(spark, folder, out, delay="2 minutes")
    assert late_rows(query) == 1
    assert not any(r[2] == "#late" for r in ranking(spark, f"{out}/table"))
    closed = rows[-1][1] - timedelta(minutes=2)
    assert ranking(spark, f"{out}/table") == expected(spark, rows, closed)


def run_drain(spark, folder, out, delay):
    messages = files(spark, folder, POSTS).select(F.col("created_at").alias("ts"), "text")
    return drain(messages, f"{out}/table", f"{out}/checkpoint", f"{out}/marks", delay=delay, reports=f"{out}/reports")


@pytest.mark.parametrize("delay", ["0 seconds", "3 minutes"])
def test_drained_stream_equals_batch(spark, tmp_path, delay):
    """All windows, also the last ones; more messages after that, and nothing twice."""
    rows, folder, out = posts(), str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, folder, "0", rows[:30], POSTS)
    add_file(spark, folder, "1", rows[30:], POSTS)
    end = rows[-1][1] + timedelta(hours=1)
    assert len(run_drain(spark, folder, out, delay)) == 2
    assert ranking(spark, f"{out}/table") == expected(spark, rows, end)
    # Nothing new: nothing to close.
    assert len(run_drain(spark, folder, out, delay)) == 1
    assert ranking(spark, f"{out}/table") == expected(spark, rows, end)
    later = [(i + 100, at + timedelta(hours=2), text, user) for i, at, text, user in rows]
    add_file(spark, folder, "2", later, POSTS)
    assert len(run_drain(spark, folder, out, delay)) == 2
    assert ranking(spark, f"{out}/table") == expected(spark, rows + later, end + timedelta(hours=2))
    reports = spark.read.parquet(f"{out}/reports")
    assert reports.count() == reports.select("window_end").distinct().count()


def test_stream_without_messages_is_drained(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, folder, "0", [], POSTS)
    assert len(run_drain(spark, folder, out, "0 seconds")) == 1


def test_progress_table_counts_late_rows(spark, tmp_path):
    """One row a batch, over two runs of a stream; the second one drops what came too late."""
    rows, folder, out = posts(), str(tmp_path / "in"), str(tmp_path / "out")
    table = ProgressTable(spark, f"{out}/progress")
    try:
        add_file(spark, folder, "0", rows, POSTS)
        table.wait_for(run_trending(spark, folder, out, delay="2 minutes"))
        late = [(i + 90, START - timedelta(hours=1, minutes=i % 2), f"#late{i % 3}", "u1") for i in range(12)]
        add_file(spark, folder, "1", late, POSTS)
        table.wait_for(run_trending(spark, folder, out, delay="2 minutes"))
    finally:
        table.close()
    found = rows_of(table.read(), "batch", "rows", "dropped")
    assert [r[0] for r in found] == list(range(len(found)))
    assert sum(r[1] for r in found) == len(rows) + len(late)
    # Counted per slot and tag: two minutes, three tags.
    assert sum(r[2] for r in found) == 6
    assert watermark_of(spark, f"{out}/checkpoint") == rows[-1][1] - timedelta(minutes=2)


def test_plain_files_stay_out_of_a_table_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "username string")
    append_batch(rows, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        append_table(rows, str(tmp_path / "t"))


def test_disorder_within_the_delay_counts(spark, tmp_path):
    rows, folder, out = posts(), str(tmp_path / "in"), str(tmp_path / "out")
    shuffled = rows[10:20] + rows[:10] + rows[20:]
    for i in range(0, 60, 10):
        add_file(spark, folder, f"{i:02}", shuffled[i : i + 10], POSTS)
    query = run_trending(spark, folder, out, delay="30 minutes")
    assert late_rows(query) == 0
    closed = rows[-1][1] - timedelta(minutes=30)
    assert ranking(spark, f"{out}/table") == expected(spark, rows, closed)


def test_follow_state_equals_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(5)}", f"u{rng.randrange(5)}", rng.choice(["follow", "unfollow"]),
             START + timedelta(hours=rng.randrange(50)), i) for i in range(120)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 120, 40):  # batches overlap in time
        add_file(spark, folder, f"{i:03}", rows[i : i + 40], FOLLOW_EVENTS)
    follow_stream(files(spark, folder, FOLLOW_EVENTS), out, f"{out}/checkpoint", ONCE).awaitTermination()
    got = followed_pairs(spark, out)
    want = fold_follow_events(spark.createDataFrame(rows, FOLLOW_EVENTS))
    assert rows_of(got, "follower", "followee") == rows_of(want, "follower", "followee")


def test_compacted_follow_state_keeps_its_files_few(spark, tmp_path):
    """Over 6 restarts the pairs, their order and the number of batch folders read stay right."""
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(4)}", f"u{rng.randrange(4)}", rng.choice(["follow", "follow", "unfollow"]),
             START + timedelta(hours=i // 3), i) for i in range(180)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = ["follower", "followee", "since_ts", "since_seq"]
    seen = []
    for i in range(0, 180, 30):
        for j in (i, i + 15):
            add_file(spark, folder, f"{j:03}", rows[j : j + 15], FOLLOW_EVENTS)
        follow_stream(files(spark, folder, FOLLOW_EVENTS), out, f"{out}/checkpoint", ONCE).awaitTermination()
        want = rows_of(fold_follow_events(spark.createDataFrame(rows[: i + 30], FOLLOW_EVENTS)), *columns)
        assert rows_of(followed_edges(spark, out), *columns) == want
        compact(spark, out)
        assert rows_of(followed_edges(spark, out), *columns) == want
        changes = Folder(spark, f"{out}/changes")
        seen.append(sum(len(changes.names(w)) for w in changes.names()))
    assert max(seen) <= 4 and len(Versions(spark, f"{out}/snapshots").names()) == 2
    # A batch that is written again, after it went into the snapshot, changes nothing.
    writer, = changes.names()
    batch = changes.names(writer)[0]
    path = f"{out}/changes/{writer}/{batch}"
    spark.read.parquet(path).collect()
    again = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    again.write.mode("overwrite").parquet(path)
    assert rows_of(followed_edges(spark, out), *columns) == want


def test_follow_state_of_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    assert followed_edges(spark, out).collect() == []
    compact(spark, out)
    assert followed_pairs(spark, out).collect() == []


def test_sign_ups_that_run_again_decide_the_same(spark, tmp_path):
    """A batch whose commit was lost finds the accounts it wrote itself, and mustn't take them for earlier ones."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = SIGN_UPS

    def run():
        sign_up_stream(
            files(spark, folder, schema),
            lambda session: session.createDataFrame([("old",)], "username string"),
            out, f"{out}/checkpoint", ONCE,
        ).awaitTermination()
        found = spark.read.parquet(f"{out}/outcomes")
        return rows_of(found, "request_id", "outcome")

    add_file(spark, folder, "0", [(1, "a", "A"), (2, "a", "B"), (3, "old", "C"), (4, None, "D")], schema)
    first = [(1, "created"), (2, "username-taken"), (3, "username-taken")]
    assert run()[:3] == first
    for name in ("0", ".0.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert run()[:3] == first
    add_file(spark, folder, "1", [(9, "a", "E"), (8, "b", "F"), (7, "b", "G")], schema)
    assert run()[-3:] == [(7, "created"), (8, "username-taken"), (9, "username-taken")]
    assert rows_of(spark.read.parquet(f"{out}/accounts").where("username is not null"), "username", "name") == [("a", "A"), ("b", "G")]


def test_post_ingest(spark, tmp_path):
    rows = posts(n=6) + [(90, START, "", "u1"), (91, START, "x" * 141, "u1"), (92, None, "now", "x")]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, folder, "0", rows[:4], POSTS)
    add_file(spark, folder, "1", rows[4:], POSTS)
    users = spark.createDataFrame([(f"u{i}", f"N{i}") for i in range(5)], "username string, name string")
    post_stream(
        files(spark, folder, POSTS), lambda _: users, f"{out}/tweets", f"{out}/checkpoint",
        send=to_table(f"{out}/topic"), rejects=f"{out}/rejects", trigger=ONCE,
    ).awaitTermination()
    tweets = read_batches(spark, f"{out}/tweets", TWEETS)
    assert tweets.columns == ["tweet_id", "created_at", "text", "username", "name"]
    names = {r.tweet_id: r.name for r in tweets.collect()}
    assert names == {i: f"N{i % 5}" for i in range(6)} | {92: None}
    assert tweets.where("created_at is null").count() == 0
    sent = spark.read.parquet(f"{out}/topic").select("value")
    assert rows_of(sent, "value") == rows_of(tweets, "text")
    problems = spark.read.parquet(f"{out}/rejects")
    assert rows_of(problems, "tweet_id", "problem") == [(90, "empty"), (91, "too_long")]


def ingest(spark, folder, out, checkpoint, users):
    post_stream(
        files(spark, folder, POSTS), lambda s: s.read.parquet(users), f"{out}/tweets",
        f"{out}/{checkpoint}", send=None, trigger=ONCE,
    ).awaitTermination()


def test_no_writer_hides_or_replaces_the_rows_of_another(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    users = f"{out}/users"
    name = "username string, name string"
    replace_table(spark.createDataFrame([("u0", "N0")], name), users)
    stored = spark.createDataFrame([(-1, START, "old", "u0", None)], TWEETS)
    replace_batches(stored.limit(0), f"{out}/tweets")
    assert read_batches(spark, f"{out}/tweets", TWEETS).count() == 0
    replace_batches(stored, f"{out}/tweets")
    add_file(spark, folder, "0", posts(n=2), POSTS)
    ingest(spark, folder, out, "first", users)
    append_table(spark.createDataFrame([("u2", "N2")], name), users)  # signs up later
    add_file(spark, folder, "1", posts(n=3)[2:], POSTS)
    ingest(spark, folder, out, "first", users)
    ingest(spark, folder, out, "second", users)
    append_batch(stored, f"{out}/tweets")
    got = read_batches(spark, f"{out}/tweets", TWEETS).groupBy("tweet_id").agg(
        F.count(F.lit(1)), F.max("name"))
    assert rows_of(got, *got.columns) == [(-1, 2, None), (0, 2, "N0"), (1, 2, None), (2, 2, "N2")]
    replace_batches(stored, f"{out}/tweets")
    assert read_batches(spark, f"{out}/tweets", TWEETS).count() == 1


def test_topic_records_and_messages(spark):
    tweets = spark.createDataFrame(posts(n=3), POSTS)
    assert topic_records(tweets).columns == ["value"]
    assert topic_records(tweets, partition=0).select("partition").first()[0] == 0
    received = topic_records(tweets, as_json=True).select(
        F.col("value").cast("binary").alias("value"), F.current_timestamp().alias("timestamp")
    )
    ours = message_posts(received).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "text")
    assert rows_of(ours, "ts", "text") == rows_of(tweets, "created_at", "text")
    plain = topic_records(tweets).select(
        F.col("value").cast("binary").alias("value"), F.current_timestamp().alias("timestamp")
    )
    assert rows_of(message_texts(plain), "text") == rows_of(tweets, "text")


def test_topic_needs_the_connector(spark):
    try:
        stream = topic_stream(spark, "localhost:9092")
    except Exception as e:
        pytest.skip(f"no Kafka connector here: {type(e).__name__}")
    assert stream.isStreaming


def test_trending_job_on_a_table(spark, tmp_path):
    rows, path, out = posts(), str(tmp_path / "tweets"), str(tmp_path / "out")
    spark.createDataFrame(rows, POSTS).write.parquet(path)
    trending_job.main([out, "--tweets", path])
    assert ranking(spark, f"{out}/trending") == expected(spark, rows, START + timedelta(days=1))
    assert spark.read.parquet(f"{out}/reports").count() > 20
