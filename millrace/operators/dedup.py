"""Removal of redelivered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_events(
    events: DataFrame,
    key: str = "event_id",
    keep_first_by: Sequence[str | Column] = ("processed_at", "event_type", "user_id", "payload"),
) -> DataFrame:
    """Exactly one row per key: the first in the given order.

    The default order leaves no ties between different rows, so a task that is
    run again keeps the same row. A shorter order reads fewer columns.
    Spark turns `row_number() = 1` into a group limit on both sides of the
    shuffle, so that however many copies a key has, each map task sends one.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in keep_first_by]
    first = Window.partitionBy(key).orderBy(*order)
    return (
        events.withColumn("_copy", F.row_number().over(first))
        .where(F.col("_copy") == 1)
        .drop("_copy")
    )


def dedup_stream(
    events: DataFrame, key: str = "event_id", horizon: str = "1 hour", spread: int = 1
) -> DataFrame:
    """Drop copies that arrive within `horizon` of the first, with bounded state.

    Time is that of arrival (the micro-batch), not of the event: nothing is ever
    late, so a first copy is kept however old the event is, and a key is
    forgotten `horizon` after its first copy came. Which copy stays is not
    defined. The result has no watermark of its own on event time.

    Streaming deduplication has no map-side step. If single keys come in very
    many copies at once, `spread` above 1 thins them first: copies are dropped
    per (key, source task modulo `spread`), and only the survivors meet on the
    key, at the price of a second shuffle and state.
    """
    marked = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    if spread > 1:
        marked = (
            marked.withColumn("_task", F.spark_partition_id() % spread)
            .dropDuplicatesWithinWatermark([key, "_task"])
            .drop("_task")
        )
    return marked.dropDuplicatesWithinWatermark([key]).drop("_arrived")
