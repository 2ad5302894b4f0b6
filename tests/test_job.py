"""The streaming job: exactly one copy through failures and restarts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import millrace.streaming.job as job_module
from millrace.schemas import ENVELOPE
from millrace.sinks import read_dead_letters, read_events
from millrace.sources import from_kafka, generate_envelopes, read_envelopes, write_envelopes
from millrace.streaming import IngestJob, start_window_counts
from helpers import physical


def broken(spark, n):
    return generate_envelopes(spark.range(n), seed=9).withColumn("value", F.lit("{").cast("binary"))


def test_stream_fills_both_tables(spark, tmp_path):
    src = str(tmp_path / "in")
    write_envelopes(generate_envelopes(spark.range(500)), src)
    write_envelopes(broken(spark, 20), src)
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    query = job.start(read_envelopes(spark, src, streaming=True), str(tmp_path / "cp"))
    query.awaitTermination()
    assert read_events(spark, job.events_root).count() == 500
    assert read_dead_letters(spark, job.letters_root).count() == 20
    observed = [p["observedMetrics"] for p in query.recentProgress if p["observedMetrics"]]
    counts = observed[0]["ingest"]
    assert (counts["messages"], counts["accepted"], counts["rejected"]) == (520, 500, 20)


def test_micro_batches_then_more(spark, tmp_path):
    src = str(tmp_path / "in")
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    for start in (0, 300, 600):
        ids = spark.range(start, start + 300, numPartitions=3)
        write_envelopes(generate_envelopes(ids), src)
        stream = read_envelopes(spark, src, streaming=True, max_files=1)
        job.start(stream, str(tmp_path / "cp")).awaitTermination()
    rows = read_events(spark, job.events_root)
    assert rows.count() == 900 and rows.select("event_id").distinct().count() == 900


def test_a_replayed_batch_gets_the_same_stamps_and_one_copy(spark, tmp_path, monkeypatch):
    """Fail after the events are written; the restart must replace, not add."""
    src = str(tmp_path / "in")
    write_envelopes(generate_envelopes(spark.range(200)), src)
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    real = job_module.write_batch

    def fails_after_writing(*args):
        real(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(job_module, "write_batch", fails_after_writing)
    query = job.start(read_envelopes(spark, src, streaming=True), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination()
    first = {r.processed_at for r in read_events(spark, job.events_root).collect()}
    assert len(first) == 1

    monkeypatch.setattr(job_module, "write_batch", real)
    job.start(read_envelopes(spark, src, streaming=True), str(tmp_path / "cp")).awaitTermination()
    rows = read_events(spark, job.events_root).collect()
    assert len(rows) == 200
    assert {r.processed_at for r in rows} == first


def test_two_streams_feed_one_table(spark, tmp_path):
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    for name, seed in (("a", 1), ("b", 2)):
        src = str(tmp_path / name)
        write_envelopes(generate_envelopes(spark.range(100), seed=seed), src)
        stream = read_envelopes(spark, src, streaming=True)
        job.start(stream, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert read_events(spark, job.events_root).count() == 200


def test_json_files_as_a_source(spark, tmp_path):
    src = str(tmp_path / "in")
    write_envelopes(generate_envelopes(spark.range(50)), src, fmt="json")
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    stream = read_envelopes(spark, src, fmt="json", streaming=True)
    job.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert read_events(spark, job.events_root).count() == 50


def test_kafka_rows_become_envelopes(spark):
    schema = (
        "key binary, value binary, topic string, partition int, offset bigint, "
        "timestamp timestamp, timestampType int, headers array<struct<key:string,value:binary>>"
    )
    when = dt.datetime(2024, 1, 1)
    rows = [(None, b"{}", "t", 3, 14, when, 0, [("event_type", b"click")])]
    got = from_kafka(spark.createDataFrame(rows, schema))
    assert got.columns == ENVELOPE.fieldNames()
    row = got.first()
    assert (bytes(row.value), row.attributes, row.message_id) == (b"{}", {"event_type": "click"}, "t-3-14")


KAFKA = (
    "key binary, value binary, topic string, partition int, offset bigint, "
    "timestamp timestamp, timestampType int, headers array<struct<key:string,value:binary>>"
)


def test_repeated_and_null_header_keys(spark):
    when = dt.datetime(2024, 1, 1)
    headers = [("a", b"1"), (None, b"x"), ("b", None), ("a", b"2"), ("c", b"3"), ("a", b"4")]
    rows = [(None, b"{}", "t", 0, n, when, 0, h) for n, h in enumerate((headers, [], None))]
    got = from_kafka(spark.createDataFrame(rows, KAFKA)).orderBy("message_id").collect()
    assert [r.attributes for r in got] == [{"a": "4", "b": None, "c": "3"}, {}, None]
    bare = spark.createDataFrame(rows, KAFKA).drop("headers")
    assert [r.attributes for r in from_kafka(bare).collect()] == [None] * 3


def test_a_micro_batch_is_bounded_in_bytes(spark, tmp_path):
    src = str(tmp_path / "in")
    write_envelopes(generate_envelopes(spark.range(400, numPartitions=4)), src)
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"))
    query = job.start(read_envelopes(spark, src, streaming=True, max_bytes="1k"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    assert read_events(spark, job.events_root).count() == 400


def test_partitions_are_a_parameter(spark, tmp_path):
    src = str(tmp_path / "in")
    write_envelopes(generate_envelopes(spark.range(50, numPartitions=1)), src)
    assert "RoundRobin" in physical(read_envelopes(spark, src, partitions=6))
    assert "RoundRobin" not in physical(read_envelopes(spark, src))


def envelopes_at(spark, *stamps):
    rows = [
        (json.dumps({"event_id": str(i), "event_type": "click"}).encode(), {}, str(i), t)
        for i, t in enumerate(stamps)
    ]
    return spark.createDataFrame(rows, ENVELOPE)


def test_window_counts_and_late_messages(spark, tmp_path):
    """A message behind the watermark is dropped, one within the lateness counts."""
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 0, minute, second)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for batch in (
        envelopes_at(spark, at(0, 5), at(0, 50), at(9)),
        envelopes_at(spark, at(20)),
        envelopes_at(spark, at(0, 30), at(14, 10)),   # first too late, second not
        envelopes_at(spark, at(59)),
    ):
        write_envelopes(batch, src)
        stream = read_envelopes(spark, src, streaming=True)
        start_window_counts(stream, out, cp, lateness="10 minutes").awaitTermination()
    got = {(r.window_start, r.event_count) for r in spark.read.parquet(out).collect()}
    assert got == {(at(0), 2), (at(9), 1), (at(14), 1), (at(20), 1)}
