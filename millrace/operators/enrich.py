"""Lineage columns, residual payload, and the split into events and rejects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json import payload_without, restored
from millrace.operators.rejects import dead_letter_columns
from millrace.schemas import (
    CORE_FIELDS,
    DEFAULT_VERSION,
    EVENTS_RAW,
    REQUIRED_COLUMNS,
)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull())


def enrich_events(
    validated: DataFrame, version: str = DEFAULT_VERSION, clock: Column | None = None
) -> DataFrame:
    """Good events in the shape of the analytics table.

    `processed_at` and `ingest_date` come from one reading of `clock`, by
    default the query's own time: one value per batch or micro-batch.
    """
    return accepted(validated).select(*_table_columns(version, clock))


def route_messages(
    validated: DataFrame, version: str = DEFAULT_VERSION, clock: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Every message once, ready for both sinks.

    Table columns are filled where `reason` is NULL, dead-letter columns where
    it is not. A required column that came out null makes the row a reject.
    `keep` names columns of the message to carry along.
    """
    good = F.col("reason").isNull()
    shaped = validated.select(
        *[
            c if name in ("processed_at", "ingest_date") else F.when(good, c).alias(name)
            for name, c in zip(EVENTS_RAW.fieldNames(), _table_columns(version, clock))
        ],
        "body",
        "missing",
        "publish_time",
        "reason",
        *keep,
    )
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED_COLUMNS])
    reason = F.when(F.col("reason").isNull() & incomplete, "required_null").otherwise(
        F.col("reason")
    )
    judged = shaped.withColumn("reason", reason)
    return judged.select(*EVENTS_RAW.fieldNames(), *dead_letter_columns(), *keep)


def _table_columns(version: str, clock: Column | None) -> list[Column]:
    now = F.current_timestamp() if clock is None else clock
    payload = payload_without("sealed", CORE_FIELDS)
    by_name = {
        "payload": F.when(F.col("mark").isNull(), payload).otherwise(restored(payload, "mark")),
        "processed_at": now,
        "ingest_date": F.to_date(now),
        "pipeline_version": F.lit(version),
    }
    return [
        by_name.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in EVENTS_RAW.fields
    ]
