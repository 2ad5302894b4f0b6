"""One row per event, however many copies there are."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import drain, physical
from millrace.operators import dedup_events, dedup_stream
from millrace.schemas import EVENTS_RAW

START = dt.datetime(2024, 1, 1)


def copies(spark, n=6000):
    """A third of the rows are copies of one event; the first comes last in order."""
    return spark.range(n, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("e"), (F.col("id") % 500).cast("string")))
        .alias("event_id"),
        (F.lit(START) + F.make_interval(secs=(F.lit(n) - F.col("id")) % 1800)).alias("publish_time"),
        F.col("id"),
    )


def test_first_copy_stays(spark):
    rows = copies(spark)
    kept = dedup_events(rows, keep_first_by=["publish_time", "id"])
    first = rows.groupBy("event_id").agg(F.min(F.struct("publish_time", "id")).alias("s"))
    expected = first.select("event_id", "s.publish_time", "s.id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, expected.collect()))


def test_default_order_has_no_ties(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [("a", "click", "u", p, when, when.date(), "1") for p in ('{"n":2}', '{"n":1}', '{"n":3}')]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, EVENTS_RAW).repartition(3)
        assert [r.payload for r in dedup_events(table).collect()] == ['{"n":1}']


def test_copies_collapse_before_the_shuffle(spark):
    plan = physical(dedup_events(copies(spark), keep_first_by=["publish_time", "id"]))
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_stream(spark, tmp_path):
    rows = copies(spark)
    rows.repartition(10).write.parquet(str(tmp_path / "in"))
    for spread in (1, 16):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4)
        kept = dedup_stream(stream.parquet(str(tmp_path / "in")), spread=spread)
        out = str(tmp_path / f"out{spread}")
        drain(kept, out, str(tmp_path / f"state{spread}"))
        got = spark.read.schema(rows.schema).parquet(out)
        assert got.count() == rows.select("event_id").distinct().count()
        assert got.select("event_id").distinct().count() == got.count()
        assert got.join(rows, ["event_id", "publish_time", "id"], "left_anti").count() == 0


def test_a_first_copy_is_kept_however_old(spark, tmp_path):
    """Events days behind the newest, in a later batch: none of them is lost."""
    src = str(tmp_path / "in")
    for n, day in enumerate((20, 1, 9)):
        rows = [(f"e{n}{i}", START + dt.timedelta(days=day), i) for i in range(30)]
        rows += [(f"e{max(0, n - 1)}{i}", START + dt.timedelta(days=day), i) for i in range(10)]
        part = spark.createDataFrame(rows, "event_id string, publish_time timestamp, id long")
        part.write.mode("append").parquet(src)
        kept = dedup_stream(spark.readStream.schema(part.schema).parquet(src))
        drain(kept, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [r.event_id for r in spark.read.schema(part.schema).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == 90


def test_stream_thins_hot_keys_before_they_meet(spark, tmp_path):
    """With the spread, the last shuffle sees at most `spread` copies per key and batch."""
    rows = copies(spark)
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = drain(
        dedup_stream(stream, spread=4), str(tmp_path / "out"), str(tmp_path / "state")
    )
    operators = [p for p in query.recentProgress if p["numInputRows"]][0]["stateOperators"]
    entries = [op["numRowsUpdated"] for op in operators]
    keys = rows.select("event_id").distinct().count()
    assert sorted(entries)[0] == keys
    assert sorted(entries)[1] <= 4 * keys
