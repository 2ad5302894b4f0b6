"""Distinct users by bitmaps of batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.sinks import ACTIVE, compact_day, read_active_users, write_active_users
from millrace.sinks import users as users_module
from millrace.sinks.snapshots import Table
from millrace.sinks.tables import _read

DAY = dt.date(2024, 1, 15)


def events(spark, *users):
    """Events of (user, day number)."""
    made = [(u, DAY + dt.timedelta(days=n)) for u, n in users]
    return spark.createDataFrame(made, "user_id string, ingest_date date")


def counts(spark, root):
    rows = plans.daily_active_users_bitmaps(read_active_users(spark, root), DAY).collect()
    return {(r.ingest_date - DAY).days: r.daily_active_users for r in rows}


def dictionary(spark, root):
    table = Table(spark, f"{root}/dictionary")
    return _read(spark, table, table.snapshot(), users_module.DICTIONARY)


def test_batches_add_up_and_replace_themselves(spark, tmp_path):
    root = str(tmp_path)
    write_active_users(events(spark, ("a", 0), ("a", 0), ("b", 0), (None, 0), ("", 1), (None, 2)), root, "b0")
    write_active_users(events(spark, ("a", 0), ("c", 0), ("a", 1)), root, "b1")
    assert counts(spark, root) == {0: 3, 1: 2}
    compact_day(spark, f"{root}/days", ACTIVE, DAY)
    assert counts(spark, root) == {0: 3, 1: 2}
    write_active_users(events(spark, ("d", 1)), root, "b0")
    assert counts(spark, root) == {0: 2, 1: 2}
    write_active_users(events(spark, (None, 0)), root, "b1")
    assert counts(spark, root) == {1: 1}
    # Every user has one number, whatever became of the batches.
    places = dictionary(spark, root)
    assert sorted(r.user_id for r in places.collect()) == ["", "a", "b", "c", "d"]
    assert places.select("shard", "place").distinct().count() == 5


@pytest.mark.parametrize("few", [True, False])
def test_users_beyond_one_bitmap(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(users_module, "SHARDS", 1)
    if not few:
        monkeypatch.setattr(users_module, "BROADCAST_USERS", 1)
    root = str(tmp_path)

    def made(first, end):
        return spark.range(first, end).select(F.col("id").cast("string").alias("user_id"),
                                              F.lit(DAY).alias("ingest_date"))

    write_active_users(made(0, 40000), root, "b0")
    write_active_users(made(30000, 70000).unionByName(made(30000, 70000)), root, "b1")
    assert counts(spark, root) == {0: 70000}
    ends = dictionary(spark, root).agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()
    assert tuple(ends) == (1, 70000, 70000)


def test_writers_that_number_at_the_same_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(users_module, "SHARDS", 1)
    root, real, calls = str(tmp_path), users_module._replace, []

    def late(*args, **kw):
        if not calls:
            calls.append(1)
            write_active_users(events(spark, ("b", 0), ("c", 0)), root, "other")
        return real(*args, **kw)

    monkeypatch.setattr(users_module, "_replace", late)
    write_active_users(events(spark, ("a", 0), ("b", 0)), root, "mine")
    assert counts(spark, root) == {0: 3}
    assert dictionary(spark, root).select("place").distinct().count() == 3
    assert dictionary(spark, root).count() == 3
