"""Each id once, across batches, rewrites and writers that meet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.schemas import EVENTS_RAW
from millrace.sinks import IDS, batch_events, compact_day, read_events, read_ids, read_rollup, write_events
from millrace.sinks import ids as ids_module
from millrace.sinks import write_ids, write_new_events
from millrace.streaming import IngestJob

DAY = dt.date(2024, 1, 15)


def rows(spark, ids, day=DAY, kind="click"):
    """Events of these ids at noon, the order of the list in the payload."""
    at = dt.datetime.combine(day, dt.time(12))
    made = [(i, kind, "u", str(n), at, day, "1.0.0") for n, i in enumerate(ids)]
    return spark.createDataFrame(made, EVENTS_RAW)


@pytest.fixture
def roots(tmp_path):
    return str(tmp_path / "ev"), str(tmp_path / "ids")


def held(spark, root):
    return sorted((r.event_id, str(r.ingest_date), r.event_type) for r in read_events(spark, root).collect())


def test_first_batch_keeps_an_id(spark, roots):
    root, ids = roots
    write_new_events(rows(spark, ["a", "b", "b", ""]), root, ids, "b0")
    late = DAY + dt.timedelta(days=400)
    write_new_events(rows(spark, ["b", "c", "", "c"], late, "error"), root, ids, "b1")
    assert held(spark, root) == [("", str(DAY), "click"), ("a", str(DAY), "click"), ("b", str(DAY), "click"),
                                 ("c", str(late), "error")]
    # The first copy within a batch stays.
    assert {r.payload for r in batch_events(spark, root, "b0").where("event_id = 'b'").collect()} == {"1"}


def test_a_batch_does_not_meet_itself(spark, roots):
    root, ids = roots
    write_new_events(rows(spark, ["a", "b"]), root, ids, "b0")
    write_new_events(rows(spark, ["b", "c"]), root, ids, "b1")
    for _ in range(2):
        write_new_events(rows(spark, ["a", "b"]), root, ids, "b0")
        write_new_events(rows(spark, ["b", "c"]), root, ids, "b1")
        compact_day(spark, root, EVENTS_RAW, DAY)
        compact_day(spark, ids, IDS, DAY)
    assert [i for i, *_ in held(spark, root)] == ["a", "b", "c"]
    assert read_ids(spark, ids).count() == 4


def test_an_index_for_a_table_that_had_none(spark, roots):
    root, ids = roots
    write_events(rows(spark, ["a", "b"]), root, "b0")
    write_ids(read_events(spark, root), ids, "history")
    write_new_events(rows(spark, ["b", "c"]), root, ids, "b1")
    write_new_events(rows(spark, ["a", "b"]), root, ids, "b0")
    assert [i for i, *_ in held(spark, root)] == ["a", "b", "c"]


def test_an_id_that_went_may_come_again(spark, roots):
    root, ids = roots
    write_new_events(rows(spark, ["a", "b"]), root, ids, "b0")
    write_new_events(rows(spark, ["a"]), root, ids, "b0")
    write_new_events(rows(spark, ["b"]), root, ids, "b1")
    write_new_events(rows(spark, []), root, ids, "b0")
    write_new_events(rows(spark, ["a"]), root, ids, "b2")
    assert [i for i, *_ in held(spark, root)] == ["a", "b"]


def test_equal_hashes_of_different_ids_are_both_kept(spark, roots, monkeypatch):
    root, ids = roots
    monkeypatch.setattr(ids_module, "id_hash", lambda: F.length("event_id").cast("long"))
    write_new_events(rows(spark, ["a", "b"]), root, ids, "b0")
    write_new_events(rows(spark, ["b", "c"]), root, ids, "b1")
    assert [i for i, *_ in held(spark, root)] == ["a", "b", "c"]


def test_a_large_batch_is_not_broadcast(spark, roots, monkeypatch):
    root, ids = roots
    monkeypatch.setattr(ids_module, "BROADCAST_IDS", 1)
    write_new_events(rows(spark, [str(n) for n in range(500)]), root, ids, "b0")
    write_new_events(rows(spark, [str(n) for n in range(250, 750)]), root, ids, "b1")
    assert read_events(spark, root).count() == 750


def test_only_doubtful_ids_are_sent_to_their_copies(spark, roots, monkeypatch):
    """Rows whose hash comes once are neither joined by id nor ordered with others; none is lost or doubled."""
    root, ids = roots
    real, plans = ids_module.write_events, []

    def noted(new, *args):
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
        return real(new, *args)

    monkeypatch.setattr(ids_module, "write_events", noted)
    write_new_events(rows(spark, [str(n) for n in range(50)]), root, ids, "b0")
    assert "Window" not in plans[-1] and "Join" not in plans[-1]
    # Known ids, ids that come twice, ids that are both, and new ones.
    write_new_events(rows(spark, [*map(str, range(40, 80)), *map(str, range(45, 55)), "60", "60"], kind="error"),
                     root, ids, "b1")
    assert "Window" in plans[-1]
    assert [(i, kind) for i, _, kind in held(spark, root)] == sorted(
        (str(n), "click" if n < 50 else "error") for n in range(80))
    first = {r.event_id: int(r.payload) for r in batch_events(spark, root, "b1").collect()}
    assert first == {str(n): n - 40 for n in range(50, 80)}


def test_only_days_with_a_hash_are_read(spark, roots, monkeypatch):
    root, ids = roots
    days = [DAY + dt.timedelta(days=n) for n in range(3)]
    for n, day in enumerate(days):
        write_new_events(rows(spark, [f"{n}{i}" for i in range(5)], day), root, ids, f"b{n}")
    real, read = ids_module._read, []

    def noted(*args, **kw):
        if "days" in kw:
            read.append(kw["days"])
        return real(*args, **kw)

    monkeypatch.setattr(ids_module, "_read", noted)
    write_new_events(rows(spark, ["x"]), root, ids, "b3")
    assert read == []
    write_new_events(rows(spark, ["y", "13"]), root, ids, "b4")
    assert read == [{str(days[1])}]


def test_days_looked_at(spark, roots):
    root, ids = roots
    write_new_events(rows(spark, ["a"]), root, ids, "b0")
    write_new_events(rows(spark, ["a"], DAY + dt.timedelta(days=2)), root, ids, "b1", days=2)
    assert read_events(spark, root).count() == 1
    write_new_events(rows(spark, ["a"], DAY + dt.timedelta(days=9)), root, ids, "b2", days=2)
    assert read_events(spark, root).count() == 2


@pytest.mark.parametrize("with_index", [True, False])
def test_writers_that_meet(spark, roots, monkeypatch, with_index):
    """Another writer brings the same id after this one has looked for it."""
    root, ids = roots
    real, calls = ids_module._without_known, []

    def looked(*args):
        out = real(*args)
        if not calls:
            calls.append(1)
            if with_index:
                write_new_events(rows(spark, ["a", "b"], kind="error"), root, ids, "other")
            else:
                write_events(rows(spark, ["z"], kind="error"), root, "other")
        return out

    monkeypatch.setattr(ids_module, "_without_known", looked)
    write_new_events(rows(spark, ["b", "c"]), root, ids, "mine")
    expected = [("a", "error"), ("b", "error"), ("c", "click")] if with_index else [
        ("b", "click"), ("c", "click"), ("z", "error")]
    assert [(i, k) for i, _, k in held(spark, root)] == expected


@pytest.mark.parametrize("part", ["write_ids", "write_events"])
@pytest.mark.parametrize("after", [False, True])
def test_a_batch_that_broke_off_is_written_again(spark, roots, monkeypatch, part, after):
    root, ids = roots
    write_new_events(rows(spark, ["a"]), root, ids, "b0")
    real = getattr(ids_module, part)

    def breaks(*args, **kw):
        if after:
            real(*args, **kw)
        raise OSError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(ids_module, part, breaks)
        with pytest.raises(OSError):
            write_new_events(rows(spark, ["a", "b"]), root, ids, "b1")
    # Its ids do not hinder others before it is written again, unless it is in the table.
    write_new_events(rows(spark, ["b", "c"]), root, ids, "b2")
    write_new_events(rows(spark, ["a", "b"]), root, ids, "b1")
    assert [i for i, *_ in held(spark, root)] == ["a", "b", "c"]


def test_job_counts_what_it_kept(spark, send, tmp_path):
    job = IngestJob(str(tmp_path / "ev"), str(tmp_path / "dl"), clock=F.col("publish_time"),
                    ids_root=str(tmp_path / "ids"), rollup_root=str(tmp_path / "counts"))
    body = '{{"event_id":"{}","event_type":"click"}}'.format
    job.run_batch(send(body("a"), body("b"), "{"), "b0")
    job.run_batch(send(body("b"), body("c")), "b1")
    job.run_batch(send(body("b"), body("a")), "b2")
    assert [i for i, *_ in held(spark, job.events_root)] == ["a", "b", "c"]
    assert read_rollup(spark, job.rollup_root).agg(F.sum("event_count")).first()[0] == 3
