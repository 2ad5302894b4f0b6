"""Counts of each batch, beside its events.

A row is the number of a batch's events of one hour, type, job version and (for errors)
error code. Counts of different batches add up, and a batch that is written again
replaces its counts like its events, so dashboards sum a few rows for each batch and
hour instead of reading the events. The table is like the others: days may be compacted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json import json_value
from millrace.sinks.snapshots import DAY, Table
from millrace.sinks.tables import _read, _replace

ROLLUP = T.StructType([
    T.StructField("hour", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("pipeline_version", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField(DAY, T.DateType()),
])


def write_rollup(events: DataFrame, root: str, batch: str) -> None:
    """Add (or replace) the counts of one batch of events."""
    code = F.when(F.col("event_type") == "error", json_value("payload", "$.error_code"))
    keys = ["hour", "event_type", "pipeline_version", "error_code", DAY]
    counted = (
        events.select(F.date_trunc("HOUR", "processed_at").alias("hour"), "event_type", "pipeline_version",
                      code.alias("error_code"), DAY)
        .groupBy(*keys).agg(F.count("*").alias("event_count"))
    )
    _replace(counted.select(*ROLLUP.fieldNames()).hint("rebalance", DAY), root, batch, ROLLUP)


def read_rollup(spark: SparkSession, root: str, since: dt.date | None = None, until: dt.date | None = None
                ) -> DataFrame:
    """The counts of all batches, of the days asked for."""
    table = Table(spark, root)
    return _read(spark, table, table.snapshot(), ROLLUP, since, until)
