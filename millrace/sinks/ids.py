"""Which event ids the table holds: a membership index beside the data.

For each batch and day the index has the 64-bit hashes of the batch's ids. A batch that
is to bring each id once writes its own hashes first, then looks for them among those of
other batches. Only ids with an equal hash are compared as texts, with the events of the
days where the hash was found: a batch without copies reads no events at all.

Of two batches that bring an id at the same time, the one that becomes part of the table
second finds that the table is not the one it looked at, and looks again. As hashes are
there before the events they stand for, it then finds the other's. A batch that is
written again does not meet itself. A table that had events before it had an index gets
one by `write_ids(read_events(spark, root), ids_root, "history")`. Hashes of rows that never came into the table cost a
comparison and change nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from millrace.operators.dedup import dedup_events
from millrace.sinks.snapshots import DAY, Conflict, Snapshot, Table
from millrace.sinks.tables import ROW_BATCH, _read, _replace, write_events

IDS = T.StructType([
    T.StructField("id_hash", T.LongType()),
    T.StructField(DAY, T.DateType()),
])
_HELD = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField(ROW_BATCH, T.StringType()),
    T.StructField(DAY, T.DateType()),
])
# Hashes of a batch that are sent to every task that reads the index (32 MB).
BROADCAST_IDS = 1 << 22
_ATTEMPTS = 20


def id_hash() -> Column:
    return F.xxhash64("event_id")


def write_new_events(
    events: DataFrame,
    root: str,
    ids_root: str,
    batch: str,
    days: int | None = None,
    extra: T.StructType | None = None,
) -> None:
    """Add (or replace) one batch of events, without copies of ids that other batches hold.

    Of copies within the batch the first stays, in the order of `dedup_events`.
    With `days` only ids from so many days before the batch's first day on are
    looked at. `events` is read several times and must give the same rows each
    time: persist it, if it is stamped or costly to make. If a batch is written again with other rows, copies of its former
    ids that were left out of other batches do not come back.
    """
    spark = events.sparkSession
    write_ids(events, ids_root, batch)
    for _ in range(_ATTEMPTS):
        base = Table(spark, root).snapshot()
        new, looked_at = _without_known(events, root, ids_root, batch, base, days)
        try:
            return write_events(new, root, batch, extra, base)
        except Conflict:
            continue
        finally:
            for rows in looked_at:
                rows.unpersist()
    raise Conflict(f"{root} was changed by others {_ATTEMPTS} times in a row")


def write_ids(events: DataFrame, root: str, batch: str) -> None:
    """Add (or replace) the hashes of one batch."""
    hashes = events.select(id_hash().alias("id_hash"), DAY).distinct()
    _replace(hashes.hint("rebalance", DAY).sortWithinPartitions(DAY, "id_hash"), root, batch, IDS)


def read_ids(spark: SparkSession, root: str, since: dt.date | None = None) -> DataFrame:
    """id_hash, row_batch, ingest_date of all batches, from a day on."""
    table = Table(spark, root)
    schema = T.StructType([*IDS.fields, T.StructField(ROW_BATCH, T.StringType())])
    return _read(spark, table, table.snapshot(), schema, since)


def _without_known(events: DataFrame, root: str, ids_root: str, batch: str, base: Snapshot,
                   days: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """One row of each id that no other batch holds in a snapshot of the table, and what to unpersist.

    Rows whose hash comes once in the batch, and in no other, go on as they are. Only the
    others are sent to where their copies are.
    """
    spark = events.sparkSession
    hashes = events.select(id_hash().alias("id_hash"))
    size = events.agg(F.count("*").alias("rows"), F.min(DAY).alias("first")).first()
    since = size["first"] - dt.timedelta(days=days) if days is not None and size["rows"] else None
    others = read_ids(spark, ids_root, since).where(F.col(ROW_BATCH) != batch)
    looked_for = F.broadcast(hashes) if size["rows"] <= BROADCAST_IDS else hashes
    hits = others.join(looked_for, "id_hash", "left_semi").select("id_hash", DAY).distinct()
    hits = hits.persist(StorageLevel.MEMORY_AND_DISK)
    repeated = hashes.groupBy("id_hash").count().where("count > 1")
    doubtful = hits.select("id_hash").union(repeated.select("id_hash")).distinct()
    doubtful = doubtful.persist(StorageLevel.MEMORY_AND_DISK)
    looked_at = [hits, doubtful]
    found = {str(r[DAY]) for r in hits.select(DAY).distinct().collect()}

    def unknown(rows: DataFrame) -> DataFrame:
        if not found:
            return rows
        held = _read(spark, Table(spark, root), base, _HELD, days=found).where(F.col(ROW_BATCH) != batch)
        suspects = events.select("event_id", id_hash().alias("id_hash")).join(
            hits.select("id_hash"), "id_hash", "left_semi").select("event_id")
        known = held.select("event_id").join(suspects, "event_id", "left_semi")
        return rows.join(known, "event_id", "left_anti")

    number = doubtful.count()
    if not number:
        return events, looked_at
    if number > BROADCAST_IDS:
        return dedup_events(unknown(events)), looked_at
    named = F.broadcast(doubtful.select(F.col("id_hash").alias("_doubtful")))
    same = id_hash() == F.col("_doubtful")
    sure = events.join(named, same, "left_anti")
    return sure.unionByName(dedup_events(unknown(events.join(named, same, "left_semi")))), looked_at
