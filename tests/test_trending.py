import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedloom.operators.running import smallest_until
from feedloom.operators.sliding import FORMS, SlidingWindow, sliding_counts
from feedloom.plans import expired, trending

START = datetime(2024, 1, 1, 23, 40)
MINUTE = timedelta(minutes=1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, tag string")


def brute(rows, spec=SlidingWindow()):
    """Counts per (window_end, tag) by walking all windows."""
    counts, epoch = Counter(), datetime(1970, 1, 1) + spec.offset
    for ts, tag in rows:
        end = epoch + ((ts - epoch) // spec.slide + 1) * spec.slide
        while end - spec.length <= ts:
            if ts < end:
                counts[end, tag] += 1
            end += spec.slide
    return counts


def counted(df):
    return Counter({(r.window_end, r.tag): r.cnt for r in df.collect()})


@settings(max_examples=4, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60 * 60), st.sampled_from(["#a", "#b", "#c"])),
                min_size=1, max_size=40))
def test_forms_equal_brute_force(spark, rows):
    rows = [(START + timedelta(seconds=s), tag) for s, tag in rows]
    want = brute(rows)
    for form in FORMS:
        assert counted(sliding_counts(frame(spark, rows), "ts", "tag", form=form)) == want, form


@pytest.mark.parametrize(
    "spec, forms",
    [
        (SlidingWindow(timedelta(minutes=5), MINUTE), FORMS),
        (SlidingWindow(timedelta(minutes=6), timedelta(minutes=2), MINUTE), FORMS),
        (SlidingWindow(MINUTE, MINUTE), FORMS),
        (SlidingWindow(timedelta(hours=30), timedelta(hours=6)), FORMS),
        (SlidingWindow(timedelta(seconds=150), MINUTE), ["expand", "chained"]),
    ],
)
def test_other_windows(spark, spec, forms):
    rng = random.Random(1)
    rows = [(START + timedelta(seconds=rng.randrange(7200)), rng.choice("#a #b".split()))
            for _ in range(60)]
    want = counted(sliding_counts(frame(spark, rows), "ts", "tag", spec, "expand"))
    assert want == brute(rows, spec)
    assert counted(sliding_counts(frame(spark, rows), "ts", "tag", spec)) == want
    for form in forms:
        assert counted(sliding_counts(frame(spark, rows), "ts", "tag", spec, form)) == want, form


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_both_time_types(spark, kind):
    rows = [(START + timedelta(minutes=7 * i), "#a") for i in range(8)]
    df = frame(spark, rows).withColumn("ts", F.col("ts").cast(kind))
    for form in FORMS:
        got = sliding_counts(df, "ts", "tag", form=form)
        assert dict(got.dtypes)["window_end"] == kind
        ends = got.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
        assert counted(ends) == brute(rows), form


def test_delta_refuses_uneven_windows(spark):
    spec = SlidingWindow(timedelta(seconds=150), MINUTE)
    with pytest.raises(ValueError):
        sliding_counts(frame(spark, [(START, "#a")]), "ts", "tag", spec, "delta")


@pytest.mark.parametrize("bad", [(0, 1), (1, 0), (1, 2), (1.5, 0.5)])
def test_bad_windows(bad):
    with pytest.raises(ValueError):
        SlidingWindow(timedelta(seconds=bad[0]), timedelta(seconds=bad[1]))


def test_window_edges(spark):
    noon = datetime(2024, 1, 1, 12)
    for form in FORMS:
        ends = sorted(e for e, _ in counted(
            sliding_counts(frame(spark, [(noon, "#a")]), "ts", "tag", form=form)))
        assert ends == [noon + i * MINUTE for i in range(1, 11)], form


def tweets(spark, rows):
    return spark.createDataFrame(
        [(i, ts, text) for i, (ts, text) in enumerate(rows)],
        "tweet_id bigint, created_at timestamp_ntz, text string",
    )


def test_ties_go_by_tag_and_repeats_count(spark):
    text = " ".join(f"#t{i:02}" for i in range(11)) + " #t05"
    rows = trending.trending(tweets(spark, [(START, text)])).collect()
    first = sorted((r.rk, r.tag, r.cnt) for r in rows if r.window_end == START + MINUTE)
    tags = ["#t05"] + [f"#t{i:02}" for i in range(10) if i != 5]
    assert first == [(i + 1, t, 2 if t == "#t05" else 1) for i, t in enumerate(tags)]


def test_null_time_and_text_give_no_rows(spark):
    rows = [(None, "#a"), (START, None), (START, "")]
    assert trending.trending(tweets(spark, rows)).count() == 0


@pytest.mark.parametrize(
    "seed, spec",
    [
        (0, SlidingWindow()),
        (1, SlidingWindow(offset=timedelta(seconds=20))),
        (2, SlidingWindow(timedelta(minutes=70), timedelta(minutes=7))),
        (3, SlidingWindow(timedelta(seconds=150), MINUTE)),
        (4, SlidingWindow(timedelta(hours=72), timedelta(hours=36))),
    ],
)
def test_keep_expired_equals_full_states(spark, seed, spec):
    rng = random.Random(seed)
    names = [f"#n{i:02}" for i in range(25)]
    rows = []
    for _ in range(40):
        gap = rng.choice([0, 0, 3, 200, 900])
        at = START + timedelta(minutes=rng.randrange(60) + gap, seconds=rng.randrange(60))
        rows.append((at, " ".join(rng.sample(names, rng.randrange(1, 4)))))
    tags = [(ts, tag) for ts, text in rows for tag in text.split(" ")]
    counts = brute(tags, spec)
    ends = [e for e, _ in counts]
    first = {}
    for (end, tag) in counts:
        first[tag] = min(first.get(tag, end), end)
    want, end = {}, min(ends)
    while end <= max(ends):
        seen = sorted((-counts[end, t], t) for t in first if first[t] <= end)
        want[end] = [(t, -c) for c, t in seen[:10]]
        end += spec.slide
    got = {}
    for r in expired.trending_keep_expired(tweets(spark, rows), spec).orderBy("window_end", "rk").collect():
        got.setdefault(r.window_end, []).append((r.tag, r.cnt))
    assert got == want


@pytest.mark.parametrize("fan, k", [(2, 1), (4, 3), (64, 10)])
def test_smallest_until_equals_sorting(spark, fan, k):
    rng = random.Random(fan)
    values = [(rng.choice([0, 5, rng.randrange(1000)]), f"t{i:03}") for i in rng.sample(range(500), 200)]
    places = sorted({0, 4, 5, 999, *(rng.randrange(1000) for _ in range(60))})
    got = smallest_until(
        spark.createDataFrame(values, "place bigint, tag string"),
        spark.createDataFrame([(p, f"x{p}") for p in places], "place bigint, name string"),
        "tag", k, 1000, "tags", fan,
    ).collect()
    assert {(r.place, r.name): r.tags for r in got} == {
        (p, f"x{p}"): sorted(v for at, v in values if at <= p)[:k] for p in places
    }


def test_no_rows_of_all_time_meet_in_one_task(spark):
    """What goes to one task is aggregated before: a few rows of each task."""
    rows = [(START + timedelta(minutes=7 * i), f"#n{i % 9} #m") for i in range(50)]
    plan = expired.trending_keep_expired(tweets(spark, rows))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert all("partial_" in lines[i + 1] for i in single)
