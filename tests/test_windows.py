"""Windows against brute force; one user has a third of all rows."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import drain, physical
from millrace.streaming import (
    Session,
    Sliding,
    Tumbling,
    assign_window,
    closed_at,
    counts_by_strategy,
    late_rows,
    session_counts,
    session_counts_by_type,
    sliding_counts,
    tumbling_counts,
    with_open_windows,
)
from millrace.streaming.windows import BY_TYPE

START = dt.datetime(2024, 1, 1)
TYPES = ("click", "error", "purchase")


def make_rows(n=900, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(40)}"
        # Whole minutes often, so that gaps of exactly the limit occur.
        offset = rng.randrange(0, 3 * 86400)
        offset = offset - offset % 60 if rng.random() < 0.5 else offset
        rows.append((START + dt.timedelta(seconds=offset), rng.choice(TYPES), user))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "publish_time timestamp, event_type string, user_id string")


def collected(df, key):
    return Counter({(r.window_start, r.window_end, r[key]): r.event_count for r in df.collect()})


def seconds(n):
    return dt.timedelta(seconds=n)


def brute_sliding(rows, size, slide, key):
    out = Counter()
    for ts, *keys in rows:
        since = int((ts - dt.datetime(1970, 1, 1)).total_seconds())
        first = (since - size) // slide * slide + slide
        for begin in range(first, since + 1, slide):
            if begin <= since < begin + size:
                start = dt.datetime(1970, 1, 1) + seconds(begin)
                out[(start, start + seconds(size), keys[key])] += 1
    return out


def brute_sessions(rows, gap_of, key):
    per_key = defaultdict(list)
    for ts, *keys in rows:
        per_key[keys[key]].append((ts, ts + seconds(gap_of(keys[0]))))
    out = Counter()
    for name, spans in per_key.items():
        merged = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
                merged[-1][2] += 1
            else:
                merged.append([start, end, 1])
        for start, end, n in merged:
            out[(start, end, name)] += n
    return out


def test_assignment(events, rows):
    assigned = assign_window(events, 60).select("publish_time", "window.start", "window.end")
    found = assigned.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.start == r.publish_time.replace(second=0, microsecond=0)
        assert r.end - r.start == seconds(60)


def test_tumbling(events, rows):
    assert collected(tumbling_counts(events, 600), "event_type") == brute_sliding(rows, 600, 600, 0)


@pytest.mark.parametrize("size,slide", [(3600, 900), (3600, 3600), (100, 40), (60, 7)])
def test_sliding(events, rows, size, slide):
    found = collected(sliding_counts(events, size, slide), "event_type")
    assert found == brute_sliding(rows, size, slide, 0)


@pytest.mark.parametrize("gap", [60, 600, 1800])
def test_sessions(events, rows, gap):
    found = collected(session_counts(events, gap), "user_id")
    assert found == brute_sessions(rows, lambda _: gap, 1)


def test_sessions_by_type(events, rows):
    gaps = {"click": 300, "purchase": 3600}
    found = collected(session_counts_by_type(events, gaps, 900), "user_id")
    assert found == brute_sessions(rows, lambda t: gaps.get(t, 900), 1)


def test_sessions_equal_spark_own(events):
    own = (
        events.groupBy(F.session_window("publish_time", "10 minutes"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("session_window.start", "session_window.end", "user_id", "n")
    )
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, session_counts(events, 600).collect()))


def test_before_the_epoch_and_null_times(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 30), "click", "u"), (None, "click", "u")]
    events = spark.createDataFrame(rows, "publish_time timestamp, event_type string, user_id string")
    expected = brute_sliding(rows[:1], 60, 60, 0)
    assert collected(tumbling_counts(events, 60), "event_type") == expected
    assert collected(sliding_counts(events, 60, 60), "event_type") == expected
    assert collected(session_counts(events, 60), "user_id") == brute_sessions(rows[:1], lambda _: 60, 1)


def test_gap_must_be_positive(events):
    with pytest.raises(ValueError):
        session_counts_by_type(events, {"click": 0}, 60)


def test_strategies(events, rows):
    plan = {"click": Sliding(3600, 900), "error": Tumbling(60), "purchase": Session(1800)}
    found = collected(counts_by_strategy(events, plan, session_keys=BY_TYPE), "event_type")
    of = {t: [r for r in rows if r[1] == t] for t in TYPES}
    expected = brute_sliding(of["click"], 3600, 900, 0)
    expected += brute_sliding(of["error"], 60, 60, 0)
    expected += brute_sessions(of["purchase"], lambda _: 1800, 0)
    assert found == expected


@pytest.mark.parametrize("plan", [
    {"click": Sliding(100, 40), "error": Tumbling(90), "purchase": Session(25)},
    {"click": Session(600), "error": Session(60)},
    {"click": Tumbling(60), "purchase": Sliding(3600, 600)},
])
def test_strategies_of_all_kinds(events, rows, plan):
    found = collected(counts_by_strategy(events, plan, session_keys=BY_TYPE), "event_type")
    expected = Counter()
    for kind, how in plan.items():
        own = [r for r in rows if r[1] == kind]
        if isinstance(how, Session):
            expected += brute_sessions(own, lambda _, gap=how.gap: gap, 0)
        else:
            slide = how.slide if isinstance(how, Sliding) else how.size
            expected += brute_sliding(own, how.size, slide, 0)
    assert found == expected
    # Grid types meet no window function; only sessions are numbered.
    has_sessions = any(isinstance(how, Session) for how in plan.values())
    assert ("Window [" in physical(counts_by_strategy(events, plan))) == has_sessions


def test_sessions_of_a_strategy_are_per_user(events, rows):
    plan = {"click": Tumbling(60), "purchase": Session(1800)}
    counts = counts_by_strategy(events, plan)
    own = [r for r in rows if r[1] == "purchase"]
    assert collected(counts.where("event_type = 'purchase'"), "user_id") == brute_sessions(own, lambda _: 1800, 1)
    assert counts.where("event_type = 'click' AND user_id IS NOT NULL").count() == 0


def test_strategies_on_a_stream(spark, events, rows, tmp_path):
    """One watermark over the rows of all types; a silent type holds nothing back."""
    plan = {"click": Sliding(3600, 900), "error": Tumbling(60), "purchase": Session(1800),
            "page_view": Tumbling(7200), "session_end": Session(60)}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = counts_by_strategy(stream, plan, lateness="1 hour")
    query = drain(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    appended = spark.read.schema(counts.schema).parquet(str(tmp_path / "out"))
    key = lambda r: str(tuple(r))
    whole = counts_by_strategy(events, plan)
    last = max(r[0] for r in rows) - seconds(3600)
    got, table = sorted(appended.collect(), key=key), sorted(whole.collect(), key=key)
    assert got == [r for r in table if r.window_end <= last] and len(got) < len(table)
    assert sorted(with_open_windows(appended, whole, closed_at(query)).collect(), key=key) == table


def test_strategies_on_a_table_read_the_rows_once(spark, events, rows):
    """What comes before the strategies, such as a parse, is done once for all of them."""
    plan = {"click": Sliding(3600, 900), "error": Tumbling(60), "purchase": Session(1800)}
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counts = counts_by_strategy(events.mapInArrow(counted, events.schema), plan)
    assert sum(r.event_count for r in counts.collect()) >= len(rows)
    assert seen.value == len(rows)


def test_late_rows_are_reported(spark):
    schema = "window_start timestamp, window_end timestamp, event_type string, event_count long"
    at = lambda n: START + dt.timedelta(minutes=n)
    appended = spark.createDataFrame([(at(0), at(1), "a", 2), (at(1), at(2), "a", 1)], schema)
    counted = spark.createDataFrame(
        [(at(0), at(1), "a", 5), (at(1), at(2), "a", 1), (at(2), at(3), "a", 4), (at(8), at(9), "a", 7)], schema)
    got = {(r.window_start, r.event_count, r.late_count, r.reason)
           for r in late_rows(appended, counted, at(3)).collect()}
    assert got == {(at(0), 2, 3, "behind_watermark"), (at(1), 1, 0, None), (at(2), 0, 4, "behind_watermark")}


def test_rows_collapse_before_the_first_shuffle(events):
    """Hot users and hot windows: a partial aggregate sits below every exchange."""
    for counted in (
        tumbling_counts(events, 60), sliding_counts(events, 3600, 900), session_counts(events, 600)
    ):
        below = physical(counted).split("Exchange")[-1]
        assert "HashAggregate" in below and "partial_count" in below
        assert "Expand" not in below


SHAPES = {
    "tumbling": lambda e, late: tumbling_counts(e, 600, lateness=late),
    "sliding": lambda e, late: sliding_counts(e, 3600, 900, lateness=late),
    "sessions": lambda e, late: session_counts(e, 1800, lateness=late),
    "by_type": lambda e, late: session_counts_by_type(e, {"click": 300}, 1800, lateness=late),
}


@pytest.mark.parametrize("name", SHAPES)
def test_stream_gives_the_closed_windows_of_the_table(spark, events, rows, name, tmp_path):
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = SHAPES[name](stream, "1 hour")
    drain(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(counts.schema).parquet(str(tmp_path / "out"))
    closed = max(r[0] for r in rows) - seconds(3600)
    table = SHAPES[name](events, None).where(F.col("window_end") <= F.lit(closed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))
    assert got.count() > 0


def test_a_filter_on_session_bounds_comes_after_merging(spark, events, rows, tmp_path):
    """Spark pushes such a filter below its own session aggregate; ours must not."""
    cut = F.lit(START + dt.timedelta(days=2, hours=12))
    everything = session_counts(events, 1800)
    after = [tuple(r) for r in everything.collect() if r.window_start >= START + dt.timedelta(days=2, hours=12)]
    kept = everything.where(F.col("window_start") >= cut)
    assert sorted(map(tuple, kept.collect())) == sorted(after)

    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    late = session_counts(stream, 1800, lateness="1 hour").where(F.col("window_start") >= cut)
    drain(late, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(late.schema).parquet(str(tmp_path / "out"))
    closed = max(r[0] for r in rows) - seconds(3600)
    assert sorted(map(tuple, got.collect())) == sorted(t for t in after if t[1] <= closed)
