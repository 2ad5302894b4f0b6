"""Day-partitioned, clustered, idempotent Parquet tables.

Layout: `<root>/ingest_date=<day>/batch=<name>/part-*.parquet`. The day comes first, so
a query over some days lists those folders only. Every write makes folders of its own;
which of them count is said by the table's snapshots (`sinks.snapshots`). Writing a
batch id again replaces that batch as a whole: on whatever days it was, in both tables,
and also if a side became empty. A reader sees all of a batch's old rows or all of its
new ones, and may read while batches are replaced or days are compacted.

Which days a batch has, or was about to have, is kept in empty files
`<root>/_batches/<id>/<day>`, so that finding them costs one listing.

`compact_day` puts the batches of a day together, cut by (type, user) into files whose
least and largest key are noted, so that a look at some users reads few files. The rows
keep their batch id in a column; a batch that is written again later is taken out.
Superseded folders stay until `clean_up` removes them.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from millrace.schemas import DEAD_LETTER, EVENTS_RAW
from millrace.sinks.snapshots import BATCH, DAY, Folder, Snapshot, Table

CLUSTER_BY = ("event_type", "user_id")
ROW_BATCH = "row_batch"
LETTERS_TABLE = T.StructType([*DEAD_LETTER.fields, T.StructField(DAY, T.DateType())])
# Of a compacted day.
FILE_BYTES = 128 << 20

# Days in one bitmap of the days that were written, more than 89 years.
_BITMAP_DAYS = 32768
_EPOCH = dt.date(1970, 1, 1)


def write_batch(routed: DataFrame, events_root: str, letters_root: str, batch: str) -> None:
    """Write one batch from `route_messages` to both tables.

    The batch is parsed once: it is persisted and read back for each table.
    """
    own = not routed.is_cached
    routed = routed.persist(StorageLevel.MEMORY_AND_DISK) if own else routed
    try:
        good = F.col("reason").isNull()
        write_events(routed.where(good), events_root, batch)
        write_dead_letters(routed.where(~good), letters_root, batch)
    finally:
        if own:
            routed.unpersist()


def write_events(
    events: DataFrame, root: str, batch: str, extra: T.StructType | None = None,
    base: Snapshot | None = None,
) -> None:
    """Add (or replace) one batch of the events table, clustered and sorted.

    Rows are rebalanced by day and type in a single pass: adaptive execution
    cuts large partitions into files of the advised size and joins small ones.
    `extra` are columns that the table has from now on; a column that was there
    as a narrower number is widened. With `base` the table must still be at that
    snapshot when the batch becomes part of it; `Conflict` if it is not.
    """
    added = list(extra.fields) if extra else []
    columns = [*EVENTS_RAW.fields, *added]
    shaped = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
    spread = shaped.hint("rebalance", DAY, CLUSTER_BY[0])
    _replace(spread.sortWithinPartitions(DAY, *CLUSTER_BY), root, batch, EVENTS_RAW,
             [(f.name, f.dataType.simpleString()) for f in added], base)


def write_dead_letters(routed: DataFrame, root: str, batch: str) -> None:
    """Add (or replace) one batch of dead letters, foldered by processing day."""
    shaped = routed.select(*LETTERS_TABLE.fieldNames())
    _replace(shaped.hint("rebalance", DAY).sortWithinPartitions(DAY, "reason"), root, batch, LETTERS_TABLE)


def _replace(rows: DataFrame, root: str, batch: str, schema: T.StructType,
             columns: Iterable[tuple[str, str]] = (), base: Snapshot | None = None) -> None:
    spark = rows.sparkSession
    table = Table(spark, root)
    before = table.days_of(batch)
    name = uuid.uuid4().hex
    now = _write(rows, root, batch, name)
    table.mark(batch, now)
    rest: dict[tuple[str, str], Folder] = {}

    def new(day: str, folders: list[Folder]) -> list[Folder]:
        out = [f for f in folders if batch not in f.batches]
        for folder in folders:
            if batch in folder.batches and len(folder.batches) > 1:
                if (day, folder.name) not in rest:
                    rest[day, folder.name] = _pack(spark, table, schema, day, [folder], without=batch)
                out.append(rest[day, folder.name])
        return [*out, Folder(f"{BATCH}={name}", (batch,))] if day in now else out

    table.change(before | now, new, columns, base)
    table.unmark(batch, before - now)


def _write(rows: DataFrame, root: str, batch: str, name: str) -> set[str]:
    """Write rows to folders of this name, one on each day; the days that have some."""
    # The days written are observed in the same pass, one bit per day.
    day = F.unix_date(DAY)
    seen = Observation()
    observed = rows.observe(
        seen, F.min(day).alias("first"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(day, F.lit(_BITMAP_DAYS)) + 1)).alias("bits"),
    )
    # Overwriting by partition has a staging folder for each job; the folders are new.
    (
        observed.withColumn(ROW_BATCH, F.lit(batch)).withColumn(BATCH, F.lit(name))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, BATCH)
        .parquet(root)
    )
    return _days_of(seen.get["first"], seen.get["bits"])


def _days_of(first: int | None, bits: bytes) -> set[str]:
    """Days whose bit is set, counted from the first of them."""
    if first is None:
        return set()
    places = [8 * i + b for i, byte in enumerate(bits) if byte for b in range(8) if byte >> b & 1]
    days = [first + (p - first) % _BITMAP_DAYS for p in places]
    return {str(_EPOCH + dt.timedelta(days=d)) for d in days}


def compact_day(spark: SparkSession, root: str, schema: T.StructType, day: dt.date,
                file_bytes: int = FILE_BYTES) -> None:
    """Put the batches of a day together in files of about `file_bytes`.

    `schema` is that of the table; columns added to it are kept without being
    named. The day may be read and written meanwhile: batches that come, or are
    replaced, while it runs are not lost.
    """
    table = Table(spark, root)
    while True:
        folders = table.folders(table.snapshot(), [str(day)]).get(str(day), [])
        if not folders or (len(folders) == 1 and folders[0].files):
            return
        packed = _pack(spark, table, schema, str(day), folders, file_bytes=file_bytes)

        def new(_: str, now: list[Folder], old=folders, packed=packed) -> list[Folder]:
            if not set(old) <= set(now):
                raise _Superseded
            return [packed, *[f for f in now if f not in old]]

        try:
            return table.change([str(day)], new)
        except _Superseded:
            continue


class _Superseded(Exception):
    """A batch that was compacted has been written again meanwhile."""


def _pack(spark: SparkSession, table: Table, schema: T.StructType, day: str, folders: list[Folder],
          without: str | None = None, file_bytes: int = FILE_BYTES) -> Folder:
    """Rewrite folders of a day as one, cut by key; without the rows of a batch, if named.

    A key with a large share of the rows is cut further by a hash of the rows.
    """
    paths = [f"{table.root}/{DAY}={day}/{f.name}" for f in folders]
    named = set(schema.fieldNames())
    stored = T.StructType([
        *[f for f in schema.fields if f.name != DAY],
        *[f for f in _added(table.snapshot().columns).fields if f.name not in named],
        T.StructField(ROW_BATCH, T.StringType())])
    inner = spark.read.schema(stored).parquet(*paths)
    rows = inner if without is None else inner.where(~F.col(ROW_BATCH).eqNullSafe(without))
    keys = [c for c in CLUSTER_BY if c in rows.columns] or ["reason" if "reason" in rows.columns else rows.columns[0]]
    size = sum(table.files.size(f"{DAY}={day}/{f.name}") for f in folders)
    count = max(1, math.ceil(size / file_bytes))
    name = f"{BATCH}={uuid.uuid4().hex}"
    path = f"{table.root}/{DAY}={day}/{name}"
    spread = F.xxhash64(*[c for c in rows.columns if c not in keys])
    rows.repartitionByRange(count, *keys, spread).sortWithinPartitions(*keys).write.parquet(path)
    ranges = spark.read.schema(rows.schema).parquet(path).groupBy("_metadata.file_name").agg(
        F.min(F.struct(*keys)).alias("least"), F.max(F.struct(*keys)).alias("most")).collect()
    files = sorted((r["file_name"], tuple(r["least"]), tuple(r["most"])) for r in ranges)
    batches = sorted({b for f in folders for b in f.batches if b != without})
    return Folder(name, tuple(batches), tuple(files))


def clean_up(spark: SparkSession, root: str, keep: dt.timedelta = dt.timedelta(days=1)) -> int:
    """Remove folders that have not been part of the table for `keep`; how many went."""
    return Table(spark, root).clean_up(keep)


def table_columns(spark: SparkSession, root: str) -> T.StructType:
    """Columns that were added to the events table, with the type they have by now."""
    return _added(Table(spark, root).snapshot().columns)


def _added(columns: Iterable[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns])


def read_events(
    spark: SparkSession,
    root: str,
    since: dt.date | None = None,
    until: dt.date | None = None,
    extra: T.StructType | None = None,
    event_types: Iterable[str] | None = None,
    users: Iterable[str] | None = None,
) -> DataFrame:
    """The events table as it is now, with its declared schema.

    With `since` or `until` only the folders of those days are listed; with
    `event_types` or `users` files of compacted days that hold none of them are
    left out. All are also filters. Columns added to the table come after the
    others (`extra` names those that are wanted): older files, which lack them,
    read as null, and no footers are merged. What is written, compacted or
    replaced later is not seen. A table nothing was written to yet reads as empty.
    """
    table = Table(spark, root)
    snapshot = table.snapshot()
    more = _added(snapshot.columns) if extra is None else extra
    schema = T.StructType([*EVENTS_RAW.fields, *more.fields])
    types, users = (None if x is None else tuple(x) for x in (event_types, users))
    rows = _read(spark, table, snapshot, schema, since, until, types, users)
    for name, wanted in zip(CLUSTER_BY, (types, users)):
        if wanted is not None:
            rows = rows.where(F.col(name).isin(*wanted))
    return rows


def batch_events(spark: SparkSession, root: str, batch: str) -> DataFrame:
    """The events of one batch, as the table holds them now."""
    table = Table(spark, root)
    schema = T.StructType([*EVENTS_RAW.fields, T.StructField(ROW_BATCH, T.StringType())])
    rows = _read(spark, table, table.snapshot(), schema, days=table.days_of(batch))
    return rows.where(F.col(ROW_BATCH) == batch).drop(ROW_BATCH)


def read_dead_letters(
    spark: SparkSession, root: str, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """The dead letters, of the processing days asked for."""
    table = Table(spark, root)
    rows = _read(spark, table, table.snapshot(), LETTERS_TABLE, since, until)
    return rows.select(*DEAD_LETTER.fieldNames())


def _read(
    spark: SparkSession,
    table: Table,
    snapshot: Snapshot,
    schema: T.StructType,
    since: dt.date | None = None,
    until: dt.date | None = None,
    event_types: tuple[str, ...] | None = None,
    users: tuple[str, ...] | None = None,
    days: Collection[str] | None = None,
) -> DataFrame:
    listed = [d for d in sorted(snapshot.lists)
              if (since is None or d >= str(since)) and (until is None or d <= str(until))
              and (days is None or d in days)]
    paths = []
    for day, folders in table.folders(snapshot, listed).items():
        for folder in folders:
            path = f"{table.root}/{DAY}={day}/{folder.name}"
            held = [n for n, *ends in folder.files if _may_hold(*ends, event_types, users)]
            if len(held) == len(folder.files):
                paths.append(path)
            else:
                paths += [f"{path}/{n}" for n in held]
    if not paths:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
    rows = spark.read.schema(stored).option("basePath", table.root).parquet(*paths).select(*schema.fieldNames())
    if since is not None:
        rows = rows.where(F.col(DAY) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(DAY) <= F.lit(until))
    return rows


def _may_hold(least: tuple, most: tuple, event_types: tuple[str, ...] | None,
              users: tuple[str, ...] | None) -> bool:
    """Can a file whose keys lie between two (type, user) hold any of those asked for?"""
    if event_types is None and users is None:
        return True
    kinds = [k for k in event_types if least[0] <= k <= most[0]] if event_types is not None else (
        {least[0], most[0]})
    if users is None:
        return bool(kinds)
    if event_types is None and least[0] != most[0]:
        return True  # there may be types between the two
    # Null comes first in order, and no user asked for is null.
    low, high = least[1] or "", most[1]
    return any(
        (k > least[0] or u.encode() >= low.encode())
        and (k < most[0] or (high is not None and u.encode() <= high.encode()))
        for k in kinds for u in users)
