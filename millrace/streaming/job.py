"""The ingestion job: messages in, events and dead letters out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from millrace.operators.enrich import accepted, route_messages
from millrace.operators.parse import parse_events
from millrace.operators.rejects import redrive
from millrace.operators.validate import validate_events
from millrace.schemas import DEFAULT_VERSION, DEFAULT_WINDOW_SECS, VALID_EVENT_TYPES
from millrace.sinks.ids import write_new_events
from millrace.sinks.ledger import ACCEPTED, next_attempt, pending, read_ledger, write_ledger
from millrace.sinks.rollups import write_rollup
from millrace.sinks.tables import batch_events, read_dead_letters, write_batch, write_dead_letters, write_events
from millrace.sinks.users import write_active_users
from millrace.streaming.windows import tumbling_counts


@dataclass(frozen=True)
class IngestJob:
    """Where the tables are and how events are judged and stamped.

    `clock` replaces the processing time, for tests and backfills. With
    `rollup_root` the counts of each batch are written, too. With `ids_root`
    events whose id another batch has brought are left out, however late they
    come; with `unique_days` ids of so many days are looked at. With `users_root`
    the users of each batch are kept as bitmaps.
    """

    events_root: str
    letters_root: str
    version: str = DEFAULT_VERSION
    event_types: Iterable[str] = VALID_EVENT_TYPES
    clock: Column | None = None
    rollup_root: str | None = None
    ids_root: str | None = None
    unique_days: int | None = None
    users_root: str | None = None

    def routed(self, envelopes: DataFrame) -> DataFrame:
        """Every message once, judged; the plan is the same for table and stream."""
        validated = validate_events(parse_events(envelopes), self.event_types)
        return route_messages(validated, self.version, self.clock)

    def run_batch(self, envelopes: DataFrame, batch: str) -> None:
        """Ingest a table of messages as one batch; the same id replaces it, whatever days it was on."""
        self._write(self.routed(envelopes), batch)

    def _write(self, routed: DataFrame, batch: str) -> None:
        if self.ids_root is None and self.rollup_root is None and self.users_root is None:
            return write_batch(routed, self.events_root, self.letters_root, batch)
        # Parsed once, for all tables.
        routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = F.col("reason").isNull()
            if self.ids_root is None:
                write_batch(routed, self.events_root, self.letters_root, batch)
                self._write_beside(routed.where(good), batch)
            else:
                self._write_events(routed.where(good), batch)
                write_dead_letters(routed.where(~good), self.letters_root, batch)
        finally:
            routed.unpersist()

    def _write_events(self, good: DataFrame, batch: str) -> None:
        if self.ids_root is None:
            write_events(good, self.events_root, batch)
        else:
            write_new_events(good, self.events_root, self.ids_root, batch, self.unique_days)
            good = batch_events(good.sparkSession, self.events_root, batch)
        self._write_beside(good, batch)

    def _write_beside(self, good: DataFrame, batch: str) -> None:
        """What is kept of the batch's events in other tables."""
        if self.rollup_root is not None:
            write_rollup(good, self.rollup_root, batch)
        if self.users_root is not None:
            write_active_users(good, self.users_root, batch)

    def redrive(self, spark: SparkSession, ledger_root: str, repaired: Column | None = None,
                since: dt.date | None = None, until: dt.date | None = None) -> int | None:
        """Send dead letters round again, those that never were: the attempt's number, None if there are none.

        `repaired` is the corrected body text; by default the stored one. Good
        events go to the events table as a batch of the attempt; what became of
        each letter goes to the ledger, and the letters stay where they are.
        """
        ledger = read_ledger(spark, ledger_root)
        letters = pending(read_dead_letters(spark, self.letters_root, since, until), ledger)
        envelopes = redrive(letters, repaired, name=F.col("letter"))
        validated = validate_events(parse_events(envelopes), self.event_types)
        routed = route_messages(validated, self.version, self.clock, keep=["message_id"]).withColumn(
            "_today", F.to_date(F.current_timestamp()))
        routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if routed.isEmpty():
                return None
            attempt = next_attempt(ledger)
            good = routed.where(F.col("reason").isNull())
            self._write_events(good, f"redrive-{attempt:09d}")
            write_ledger(routed.select(
                F.col("message_id").alias("letter"), F.coalesce("reason", F.lit(ACCEPTED)).alias("outcome"),
                F.col("_today").alias("ingest_date")), ledger_root, attempt)
            return attempt
        finally:
            routed.unpersist()

    def start(
        self,
        envelopes: DataFrame,
        checkpoint: str,
        interval: str | None = None,
        name: str | None = None,
    ) -> StreamingQuery:
        """Ingest a stream; without `interval`, everything available, then stop.

        Rows are stamped in the streaming plan itself, where the processing
        time is part of the checkpoint: a replayed batch gets the same stamps,
        lands in the same day and replaces its first copy. Batches are named
        after the query, whose id lives in the checkpoint, so that several
        streams may feed one table. Accepted and rejected counts are in the
        progress of the query, under `ingest`.
        """
        observed = self.routed(envelopes).observe(
            "ingest",
            F.count(F.lit(1)).alias("messages"),
            F.count_if(F.col("reason").isNull()).alias("accepted"),
            F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        )

        def write(routed: DataFrame, number: int) -> None:
            query = routed.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self._write(routed, f"{query}-{number:09d}")

        writer = observed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        writer = writer.queryName(name) if name else writer
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()


def start_window_counts(
    envelopes: DataFrame,
    out: str,
    checkpoint: str,
    size: int = DEFAULT_WINDOW_SECS,
    lateness: str = "10 minutes",
    event_types: Iterable[str] = VALID_EVENT_TYPES,
    interval: str | None = None,
) -> StreamingQuery:
    """Tumbling counts of good events, appended once a window is complete.

    A window is complete when the watermark (latest publish time seen, minus
    `lateness`) has passed its end; events that come after that are dropped from
    the counts (the table has them). `late_rows` finds what was dropped,
    `with_open_windows` adds the windows that were open when a stream ended.
    """
    good = accepted(validate_events(parse_events(envelopes), event_types))
    counts = tumbling_counts(good, size, lateness=lateness)
    writer = counts.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
