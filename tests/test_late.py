"""Late rows as an output of the stream, against a model of the watermark."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from helpers import drain
from pyspark.sql import functions as F

from millrace.streaming import tumbling_counts, tumbling_with_late_rows

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FORM = "event_id string, event_type string, publish_time timestamp"
SIZE, LATENESS = 60, 300


def batches(seed):
    """Batches whose times move on, with stragglers; a type with most of the rows; a null time."""
    rng = random.Random(seed)
    out = []
    for b in range(4):
        rows = []
        for i in range(120):
            at = 900 * b + rng.randint(0, 900)
            if rng.random() < 0.2:
                at = rng.randint(0, 900 * b + 1)
            rows.append((f"{b}-{i}", rng.choice(["a", "a", "a", "b", "c"]), START + dt.timedelta(seconds=at)))
        out.append(rows + [(f"{b}-null", "a", None)])
    return out


def model(parts, refine):
    given, late, closed, mark = defaultdict(int), [], {}, None
    seen = defaultdict(int)
    for rows in parts:
        for name, kind, at in rows:
            if at is None:
                continue
            begin = START + dt.timedelta(seconds=(at - START).total_seconds() // SIZE * SIZE)
            end = begin + dt.timedelta(seconds=SIZE)
            if mark is not None and end <= mark:
                seen[kind, begin] += 1
                known = mark < end + dt.timedelta(seconds=refine)
                late.append((name, kind, begin, at, known))
            else:
                given[kind, begin] += 1
        latest = max(at for _, _, at in rows if at is not None)
        mark = max(filter(None, [mark, latest - dt.timedelta(seconds=LATENESS)]))
    closed = {(k, b): n for (k, b), n in given.items() if b + dt.timedelta(seconds=SIZE) <= mark}
    return closed, late, given, seen


@pytest.mark.parametrize("refine", [0, 10**6])
def test_windows_and_late_rows(spark, tmp_path, refine):
    parts = batches(refine)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shape = lambda rows: tumbling_with_late_rows(rows, SIZE, LATENESS, refine)
    for rows in parts:
        spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(src)
        stream = shape(spark.readStream.schema(FORM).parquet(src))
        drain(stream, out, state)
    found = spark.read.schema(stream.schema).parquet(out).select(
        "*", F.unix_seconds("window_start").alias("begin")).collect()
    at = lambda t: int(t.timestamp())
    closed, late, given, seen = model(parts, refine)
    windows = {(r.event_type, r.begin): r.event_count for r in found if r.kind == "window"}
    assert windows == {(k, at(b)): n for (k, b), n in closed.items()}
    # Each late row once.
    assert sorted((r.event_id, r.event_type, r.begin) for r in found if r.kind == "late") == sorted(
        (n, k, at(b)) for n, k, b, _, _ in late)
    assert len(late) > 10
    refined = defaultdict(list)
    for r in found:
        if r.kind == "late":
            refined[r.event_type, r.begin].append(r.event_count)
    for (kind, begin), counts in refined.items():
        key = (kind, dt.datetime.fromtimestamp(begin, dt.timezone.utc))
        if refine:
            assert sorted(counts) == [given[key] + i + 1 for i in range(seen[key])]


def test_the_windows_are_those_of_the_plain_aggregate(spark, tmp_path):
    parts = batches(7)
    src = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(FORM).parquet(src)
        drain(tumbling_counts(stream, SIZE, lateness=f"{LATENESS} seconds"), str(tmp_path / "a"), str(tmp_path / "sa"))
        late = tumbling_with_late_rows(stream, SIZE, LATENESS)
        drain(late, str(tmp_path / "b"), str(tmp_path / "sb"))
    plain = spark.read.parquet(str(tmp_path / "a")).select("window_start", "event_type", "event_count")
    mine = spark.read.parquet(str(tmp_path / "b")).where("kind = 'window'").select(
        "window_start", "event_type", "event_count")
    assert sorted(map(str, plain.collect())) == sorted(map(str, mine.collect()))
