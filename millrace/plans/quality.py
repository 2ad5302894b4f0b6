"""Data-quality checks on the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_ready(events: DataFrame, day: dt.date) -> DataFrame:
    """One row: does the day have any data? Each task stops at its first row."""
    return (
        events.where(F.col("ingest_date") == F.lit(day))
        .select(F.lit(1))
        .limit(1)
        .agg((F.count("*") > 0).alias("ready"))
    )


def quality_check(events: DataFrame, day: dt.date) -> DataFrame:
    """One row: does the day have at least one event with id and type?"""
    complete = F.col("event_id").isNotNull() & F.col("event_type").isNotNull()
    return events.where((F.col("ingest_date") == F.lit(day)) & complete).agg(
        (F.count("*") > 0).alias("ok")
    )


def quality_report(events: DataFrame, day: dt.date) -> DataFrame:
    """One row: rows, missing ids and types of the day, and the verdict.

    Passes only if there are rows and none lacks its id or type.
    """
    counted = events.where(F.col("ingest_date") == F.lit(day)).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("event_id").isNull()).alias("null_event_ids"),
        F.count_if(F.col("event_type").isNull()).alias("null_event_types"),
    )
    passed = (
        (F.col("row_count") > 0)
        & (F.col("null_event_ids") == 0)
        & (F.col("null_event_types") == 0)
    )
    return counted.withColumn("passed", passed)


def missing_days(events: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Events per day for each of the last days, zero where nothing came.

    The calendar enters as rows that count nothing, so one aggregate does the
    work of counting and of an outer join.
    """
    first = as_of - dt.timedelta(days=days)
    in_range = F.col("ingest_date").between(F.lit(first), F.lit(as_of))
    calendar = events.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("ingest_date"),
        F.lit(0).alias("n"),
    )
    seen = events.where(in_range).select("ingest_date", F.lit(1).alias("n"))
    return (
        seen.unionByName(calendar)
        .groupBy("ingest_date")
        .agg(F.sum("n").alias("total_events"))
        .withColumn("is_missing", F.col("total_events") == 0)
        .orderBy(F.desc("ingest_date"))
    )


def require(check: DataFrame, message: str) -> None:
    """Fail the job unless the one boolean in `check` is true."""
    verdict = F.assert_true(F.col(check.columns[-1]), message)
    check.select(verdict).collect()
