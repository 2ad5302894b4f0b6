"""Distinct users per day, kept by batch as exact bitmaps.

A dictionary numbers each user once: users are dealt to shards by a hash, and within its
shard a user has a place, counted from 1. A bitmap holds the users of a batch and a day
whose places lie in the same 32,768 of a shard. Bitmaps of different batches are joined
by "or", so that the number of distinct users of any days comes from a few rows for each
batch, without the users; a batch that is written again replaces its bitmaps.

The dictionary is only added to. Two writers that number users at the same time are told
apart by the dictionary's snapshot: the second one looks again.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from millrace.sinks.snapshots import DAY, Conflict, Table
from millrace.sinks.tables import _read, _replace

# The table's day is that on which the user was first seen by a writer.
DICTIONARY = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("place", T.LongType()),
    T.StructField(DAY, T.DateType()),
])
ACTIVE = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("bits", T.BinaryType()),
    T.StructField(DAY, T.DateType()),
])
# Of a dictionary from its first batch on.
SHARDS = 64
# Users of a batch that are sent to every task that reads the dictionary.
BROADCAST_USERS = 1 << 19
_ATTEMPTS = 20


def write_active_users(events: DataFrame, root: str, batch: str) -> None:
    """Add (or replace) the users of one batch of events; null is no user.

    `events` is read twice and must give the same rows each time.
    """
    users = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.min(DAY).alias(DAY), F.collect_set(DAY).alias("_days"))
    users = users.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        places = _places(users, f"{root}/dictionary")
        active = users.join(places, "user_id").select(
            F.explode("_days").alias(DAY), "shard", F.bitmap_bucket_number("place").alias("bucket"), "place")
        bitmaps = active.groupBy("shard", "bucket", DAY).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        _replace(bitmaps.select(*ACTIVE.fieldNames()).hint("rebalance", DAY), f"{root}/days", batch, ACTIVE)
    finally:
        users.unpersist()


def _places(users: DataFrame, root: str) -> DataFrame:
    """user_id, shard, place of some users; those that had none have one afterwards."""
    spark = users.sparkSession
    named = users.select("user_id")
    few = users.count() <= BROADCAST_USERS
    for _ in range(_ATTEMPTS):
        base = Table(spark, root).snapshot()
        known = _read(spark, Table(spark, root), base, DICTIONARY).drop(DAY)
        seen = known.join(F.broadcast(named) if few else named, "user_id", "left_semi")
        new = users.join(seen, "user_id", "left_anti").withColumn(
            "shard", F.pmod(F.xxhash64("user_id"), F.lit(SHARDS)).cast("int"))
        if new.isEmpty():
            return seen
        last = known.groupBy("shard").agg(F.max("place").alias("_last"))
        rank = F.row_number().over(Window.partitionBy("shard").orderBy("user_id"))
        numbered = new.join(F.broadcast(last), "shard", "left").withColumn(
            "place", F.coalesce("_last", F.lit(0)) + rank)
        rows = numbered.select(*DICTIONARY.fieldNames()).hint("rebalance", DAY)
        try:
            _replace(rows.sortWithinPartitions("user_id"), root, uuid.uuid4().hex, DICTIONARY, base=base)
        except Conflict:
            continue
        table = Table(spark, root)
        known = _read(spark, table, table.snapshot(), DICTIONARY).drop(DAY)
        return known.join(F.broadcast(named) if few else named, "user_id", "left_semi")
    raise Conflict(f"{root} was changed by others {_ATTEMPTS} times in a row")


def read_active_users(spark: SparkSession, root: str, since: dt.date | None = None,
                      until: dt.date | None = None) -> DataFrame:
    """The bitmaps of all batches, of the days asked for."""
    table = Table(spark, f"{root}/days")
    return _read(spark, table, table.snapshot(), ACTIVE, since, until)
