"""The tables on disk: layout, clustering, pruning, replay, evolution."""

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import enrich_events, parse_events, route_messages, validate_events
from millrace.schemas import EVENTS_RAW
from millrace.sinks import (
    LETTERS_TABLE,
    clean_up,
    compact_day,
    read_dead_letters,
    read_events,
    write_batch,
    write_events,
)
from millrace.sinks import tables
from millrace.sinks.snapshots import Files
from millrace.sinks.tables import _days_of
from millrace.streaming import IngestJob

DAY = dt.date(2024, 1, 15)
NOW = dt.timedelta(seconds=-1)
KINDS = ["click", "error", "page_view", "purchase"]


def messages(spark, n=4000, day=DAY, days=3):
    """A third of the events belong to one user; every 50th message is broken."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % 4 + 1).cast("int"))
    user = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 97))
    body = F.to_json(F.struct(F.col("id").cast("string").alias("event_id"),
                              kind.alias("event_type"), user.alias("user_id"),
                              (F.col("id") % 7).alias("n")))
    return spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 50 == 0, "{").otherwise(body).cast("binary").alias("value"),
        F.create_map(F.lit("a"), F.lit("b")).alias("attributes"),
        F.col("id").cast("string").alias("message_id"),
        F.date_add(F.lit(day), (F.col("id") % days).cast("int")).cast("timestamp").alias("publish_time"),
    )


def events(spark, **kw):
    return enrich_events(
        validate_events(parse_events(messages(spark, **kw))), clock=F.col("publish_time")
    )


def routed(spark, **kw):
    return route_messages(
        validate_events(parse_events(messages(spark, **kw))), clock=F.col("publish_time")
    )


def files(root):
    return sorted(p for p in Path(root).rglob("*.parquet") if not p.name.startswith("."))


def test_both_tables_hold_every_message(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    write_batch(routed(spark), ev, dl, "b1")
    assert read_events(spark, ev).count() == 4000 - 80
    assert read_dead_letters(spark, dl).count() == 80
    same = read_events(spark, ev).exceptAll(events(spark)).count()
    assert same == 0


def test_replay_leaves_one_copy(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    for _ in range(2):
        write_batch(routed(spark), ev, dl, "b1")
    write_batch(routed(spark, n=100), ev, dl, "b2")
    assert read_events(spark, ev).count() == 4000 - 80 + 98
    assert read_dead_letters(spark, dl).count() == 80 + 2


def sorted_keys(path):
    table = pq.read_table(path, partitioning=None).select(["event_type", "user_id"])
    keys = list(zip(*table.to_pydict().values()))
    assert keys == sorted(keys), path
    return keys


def test_a_batch_replaces_itself_on_other_days(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    write_batch(routed(spark), ev, dl, "b1")
    write_batch(routed(spark, n=500), ev, dl, "b2")
    write_batch(routed(spark, day=DAY + dt.timedelta(days=40)), ev, dl, "b1")
    rows = read_events(spark, ev)
    assert rows.count() == 4000 - 80 + 490
    assert rows.where(F.col("ingest_date") < F.lit(DAY + dt.timedelta(days=9))).count() == 490
    assert read_dead_letters(spark, dl).count() == 90
    assert read_dead_letters(spark, dl, since=DAY + dt.timedelta(days=9)).count() == 80
    assert read_dead_letters(spark, dl, DAY, DAY + dt.timedelta(days=2)).count() == 10


def test_a_side_that_became_empty_is_replaced_too(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    write_batch(routed(spark, n=100), ev, dl, "b1")
    refused = validate_events(parse_events(messages(spark, n=100)), ["refund"])
    write_batch(route_messages(refused, clock=F.col("publish_time")), ev, dl, "b1")
    assert (read_events(spark, ev).count(), read_dead_letters(spark, dl).count()) == (0, 100)
    write_batch(routed(spark, n=0), ev, dl, "b1")
    assert (read_events(spark, ev).count(), read_dead_letters(spark, dl).count()) == (0, 0)


def test_days_are_read_off_the_bitmap(spark):
    days = [dt.date(1969, 12, 30), dt.date(1970, 1, 1), dt.date(2024, 2, 29)]
    rows = spark.createDataFrame([(d,) for d in [*days, None]], "d date")
    day = F.unix_date("d")
    first, bits = rows.agg(F.min(day), F.bitmap_construct_agg(
        F.bitmap_bit_position(F.pmod(day, F.lit(32768)) + 1))).first()
    assert _days_of(first, bits) == {str(d) for d in days}
    assert _days_of(None, b"") == set()


def test_compaction(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    for n in range(4):
        write_batch(routed(spark, n=300 + n), ev, dl, f"b{n}")
    before = {t: sorted(map(str, read(spark, t_root).collect())) for t, t_root, read in
              (("ev", ev, read_events), ("dl", dl, read_dead_letters))}
    folder = tmp_path / "ev" / f"ingest_date={DAY}"
    many = len(files(folder))
    for _ in range(2):
        compact_day(spark, ev, EVENTS_RAW, DAY)
        compact_day(spark, dl, LETTERS_TABLE, DAY)
    compact_day(spark, ev, EVENTS_RAW, dt.date(2001, 1, 1))
    assert many == 4 and len(files(folder)) == 5
    # Superseded folders stay for their readers, until they are cleaned up.
    assert clean_up(spark, ev) == 0
    assert clean_up(spark, ev, NOW) == 4
    assert len(files(folder)) == 1
    sorted_keys(files(folder)[0])
    assert sorted(map(str, read_events(spark, ev).collect())) == before["ev"]
    assert sorted(map(str, read_dead_letters(spark, dl).collect())) == before["dl"]
    # A compacted batch that is written again is still one copy.
    write_batch(routed(spark, n=301), ev, dl, "b1")
    assert sorted(map(str, read_events(spark, ev).collect())) == before["ev"]
    write_batch(routed(spark, n=0), ev, dl, "b1")
    assert read_events(spark, ev).count() == len(before["ev"]) - (301 - 7)
    compact_day(spark, ev, EVENTS_RAW, DAY)
    assert read_events(spark, ev).count() == len(before["ev"]) - (301 - 7)


class Broken(Exception):
    pass


def breaking(monkeypatch, at):
    """Every operation on small files is counted, as is every write of data; the one at `at` breaks off."""
    done = []

    def counted(name, real):
        def run(*args, **kw):
            done.append(name)
            if len(done) == at:
                raise Broken(name)
            return real(*args, **kw)
        return run

    for name in ("names", "times", "read", "write", "put", "remove", "size"):
        monkeypatch.setattr(Files, name, counted(name, getattr(Files, name)))
    for name in ("_write", "_pack"):
        monkeypatch.setattr(tables, name, counted(name, getattr(tables, name)))
    return done


def small(spark, batch, shift=0, n=12):
    """A few rows of a batch on two days."""
    return spark.createDataFrame(
        [(f"{batch}-{i}", KINDS[i % 4], f"u{i}", "{}", dt.datetime(2024, 1, 15), DAY + dt.timedelta(days=i % 2 + shift), "1")
         for i in range(n)], EVENTS_RAW)


def held(spark, root):
    return sorted((r.event_id, r.ingest_date) for r in read_events(spark, root).collect())


@pytest.mark.parametrize("step", ["write", "rewrite", "compact", "rewrite compacted", "clean up"])
def test_the_old_or_the_new_state_whatever_breaks_off(spark, tmp_path, step, monkeypatch):
    def prepare(root):
        for b in ("b0", "b1"):
            write_events(small(spark, b), root, b)
        if step == "rewrite compacted":
            compact_day(spark, root, EVENTS_RAW, DAY)

    def change(root):
        if step in ("rewrite", "rewrite compacted"):
            write_events(small(spark, "b0", shift=1, n=7), root, "b0")
        elif step == "write":
            write_events(small(spark, "b2"), root, "b2")
        elif step == "compact":
            compact_day(spark, root, EVENTS_RAW, DAY)
        else:
            clean_up(spark, root, NOW)

    first = str(tmp_path / "whole")
    prepare(first)
    before = held(spark, first)
    with monkeypatch.context() as patch:
        breaking(patch, 0)
        change(first)
    after = held(spark, first)
    assert (before == after) == (step in ("compact", "clean up"))
    at = 0
    while True:
        at += 1
        root = str(tmp_path / f"broken-{at}")
        prepare(root)
        with monkeypatch.context() as patch:
            breaking(patch, at)
            try:
                change(root)
                broke = False
            except Broken:
                broke = True
        assert held(spark, root) in (before, after), at
        change(root)
        assert held(spark, root) == after, at
        if not broke:
            break
    assert at > 4


def test_a_reader_keeps_what_it_began_with(spark, tmp_path):
    root = str(tmp_path / "ev")
    for b in ("b0", "b1"):
        write_events(small(spark, b), root, b)
    began = read_events(spark, root)
    before = held(spark, root)
    write_events(small(spark, "b0", shift=3), root, "b0")
    for n in range(5):
        compact_day(spark, root, EVENTS_RAW, DAY + dt.timedelta(days=n))
    assert sorted((r.event_id, r.ingest_date) for r in began.collect()) == before
    assert len(held(spark, root)) == len(before)


def test_writers_that_meet_on_a_day_both_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ev")
    write_events(small(spark, "b0"), root, "b0")
    write_events(small(spark, "b1"), root, "b1")
    real, met = tables._pack, []

    def meanwhile(*args, **kw):
        packed = real(*args, **kw)
        if not met:
            met.append(1)
            write_events(small(spark, "b0", n=5), root, "b0")  # a batch that is being compacted
            write_events(small(spark, "b9"), root, "b9")
        return packed

    monkeypatch.setattr(tables, "_pack", meanwhile)
    compact_day(spark, root, EVENTS_RAW, DAY)
    names = [i.split("-")[0] for i, _ in held(spark, root)]
    assert {b: names.count(b) for b in names} == {"b0": 5, "b1": 12, "b9": 12}
    put, lost = Files.put, []

    def late(self, below, text):
        if not lost:
            lost.append(1)
            write_events(small(spark, "b8"), root, "b8")
        return put(self, below, text)

    monkeypatch.setattr(Files, "put", late)
    write_events(small(spark, "b7"), root, "b7")
    assert [i.split("-")[0] for i, _ in held(spark, root)].count("b8") == 12
    assert [i.split("-")[0] for i, _ in held(spark, root)].count("b7") == 12


def test_nothing_that_counts_is_cleaned_up(spark, tmp_path):
    root = str(tmp_path / "ev")
    for n in range(3):
        write_events(small(spark, "b0", n=6 + n), root, "b0")
    (tmp_path / "ev" / f"ingest_date={DAY}" / "batch=left over").mkdir()
    assert clean_up(spark, root, dt.timedelta(hours=1)) == 0
    assert clean_up(spark, root, NOW) == 2 * 2 + 1
    assert len(held(spark, root)) == 8
    assert len([f for f in (tmp_path / "ev" / "_snapshots").iterdir() if f.suffix == ".json"]) == 1
    assert clean_up(spark, root, NOW) == 0


def test_few_files_are_read_for_some_users(spark, tmp_path):
    root = str(tmp_path / "ev")
    rows = events(spark, n=40000, days=1)
    for n in range(3):
        write_events(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n), root, f"b{n}")
    compact_day(spark, root, EVENTS_RAW, DAY, file_bytes=8_000)
    every = len(read_events(spark, root).inputFiles())
    assert every > 12
    for kinds, users in ((["click"], ["u5"]), (["click", "error"], ["u5", "u90"]), (None, ["u5"]), (["purchase"], None),
                         (["click"], ["hot"]), (["no such"], ["u5"]), (["click"], [])):
        some = read_events(spark, root, event_types=kinds, users=users)
        wanted = rows.where((F.lit(True) if kinds is None else F.col("event_type").isin(kinds))
                            & (F.lit(True) if users is None else F.col("user_id").isin(users)))
        assert some.count() == wanted.count(), (kinds, users)
        if kinds and users == ["u5"]:
            assert len(some.inputFiles()) <= every // 6
    # The user with a third of the rows is in several files, none of them much larger than others.
    sizes = [p.stat().st_size for p in files(tmp_path / "ev") if p.parent.name in {
        Path(f).parent.name for f in read_events(spark, root).inputFiles()}]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def test_users_may_be_null(spark, tmp_path):
    root = str(tmp_path / "ev")
    rows = small(spark, "b0").withColumn("user_id", F.when(F.col("event_type") != "click", F.col("user_id")))
    write_events(rows, root, "b0")
    compact_day(spark, root, EVENTS_RAW, DAY, file_bytes=1)
    assert read_events(spark, root).count() == 12
    assert read_events(spark, root, event_types=["page_view"]).count() == 3
    assert read_events(spark, root, event_types=["page_view"], users=["u2"]).count() == 1
    assert read_events(spark, root, event_types=["click"], users=["u0"]).count() == 0


def test_columns_that_were_added_and_widened(spark, tmp_path):
    root = str(tmp_path / "ev")
    added = lambda ddl: T.StructType.fromDDL(ddl)
    write_events(small(spark, "b0"), root, "b0")
    write_events(small(spark, "b1").withColumn("n", F.lit(7)), root, "b1", added("n int"))
    write_events(small(spark, "b2").withColumn("n", F.lit(2**40)).withColumn("note", F.lit("x")), root, "b2",
                 added("n bigint, note string"))
    write_events(small(spark, "b3").withColumn("n", F.lit(9)), root, "b3", added("n int"))
    want = {"b0": {(None, None)}, "b1": {(7, None)}, "b2": {(2**40, "x")}, "b3": {(9, None)}}
    for _ in range(2):
        rows = read_events(spark, root)
        assert rows.schema["n"].dataType.simpleString() == "bigint"
        got = {}
        for r in rows.collect():
            got.setdefault(r.event_id.split("-")[0], set()).add((r.n, r.note))
        assert got == want
        compact_day(spark, root, EVENTS_RAW, DAY)
    with pytest.raises(ValueError, match="note"):
        write_events(small(spark, "b4").withColumn("note", F.lit(1)), root, "b4", added("note int"))
    assert len(held(spark, root)) == 48


def test_single_pass_write_is_sorted_and_cuts_a_hot_type(spark, tmp_path):
    root = str(tmp_path / "ev")
    rows = events(spark, n=40000, days=1).withColumn("event_type", F.lit("click"))
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "100kb")
    try:
        write_events(rows, root, "b1")
    finally:
        spark.conf.set(advisory, before)
    sizes = [len(sorted_keys(p)) for p in files(root)]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2
    assert read_events(spark, root).count() == 40000 - 800


def test_small_batches_make_one_file(spark, tmp_path):
    ev, dl = str(tmp_path / "ev"), str(tmp_path / "dl")
    write_batch(routed(spark, days=1), ev, dl, "b1")
    assert len(files(ev)) == 1


def test_only_the_days_asked_for_are_listed(spark, tmp_path):
    root = str(tmp_path / "ev")
    write_events(events(spark), root, "b1")
    rows = read_events(spark, root, DAY, DAY)
    assert {r.ingest_date for r in rows.select("ingest_date").distinct().collect()} == {DAY}
    assert all(f"ingest_date={DAY}" in f for f in rows.inputFiles())
    since = read_events(spark, root, since=DAY + dt.timedelta(days=1))
    assert since.count() == read_events(spark, root).where(F.col("ingest_date") > F.lit(DAY)).count()
    nothing = read_events(spark, root, dt.date(2023, 1, 1), dt.date(2023, 1, 3))
    assert nothing.count() == 0 and nothing.columns == rows.columns


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    root = str(tmp_path / "ev")
    write_events(events(spark), root, "b1")
    rows = read_events(spark, root).where(
        (F.col("ingest_date") == F.lit(DAY)) & (F.col("event_type") == "error")
    )
    plan = rows.select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
    assert "PartitionFilters: [isnotnull(ingest_date" in plan
    assert "ReadSchema: struct<event_type:string,user_id:string>" in plan


def test_empty_table_is_readable(spark, tmp_path):
    rows = read_events(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and "payload" in rows.columns
    assert read_dead_letters(spark, str(tmp_path / "none")).count() == 0


def test_columns_added_later_read_as_null_in_older_files(spark, tmp_path):
    root = str(tmp_path / "ev")
    added = T.StructType([T.StructField("n", T.LongType())])
    write_events(events(spark), root, "old")
    wider = events(spark, n=300).withColumn("n", F.get_json_object("payload", "$.n"))
    write_events(wider, root, "new", extra=added)
    rows = read_events(spark, root, extra=added)
    assert rows.count() == 3920 + 294
    assert rows.where("n is not null").count() == 294
    assert read_events(spark, root).count() == 3920 + 294


def test_run_batch(spark, tmp_path):
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"), version="2.0.0")
    job.run_batch(messages(spark), "load")
    job.run_batch(messages(spark), "load")
    rows = read_events(spark, job.events_root)
    assert rows.count() == 3920
    assert [r.pipeline_version for r in rows.select("pipeline_version").distinct().collect()] == ["2.0.0"]
