"""The dashboard queries.

Each takes the events table and `as_of`, the day that counts as today (by
default the current date). Date bounds are on the partition column, so only
those days are scanned, and only the columns named here are read. `over_table`
runs one on a stored table and lists no other days either.
"""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.json import json_value
from millrace.sinks.tables import read_events

# Amounts of up to ten digits before the point and twelve after it are summed as
# decimals: a total of doubles depends on the order in which they are added, a
# total of decimals does not. It holds 10^16 of them.
EXACT = "decimal(28,12)"
_EXACT_TEXT = r"^-?[0-9]{1,10}(\.[0-9]{1,12})?$"


def _today(as_of: dt.date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def _since(as_of: dt.date | None, days: int) -> Column:
    return F.col("ingest_date") >= F.date_sub(_today(as_of), days)


def hourly_volume(events: DataFrame, as_of: dt.date | None = None, days: int = 1) -> DataFrame:
    """Events per hour and type, newest and largest first."""
    return (
        events.where(_since(as_of, days))
        .groupBy(F.date_trunc("HOUR", "processed_at").alias("hour"), "event_type")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("hour"), F.desc("event_count"))
    )


def daily_active_users(
    events: DataFrame, as_of: dt.date | None = None, days: int = 7
) -> DataFrame:
    """Exact number of distinct known users per day."""
    return (
        events.where(_since(as_of, days) & F.col("user_id").isNotNull())
        .groupBy("ingest_date")
        .agg(F.countDistinct("user_id").alias("daily_active_users"))
        .orderBy(F.desc("ingest_date"))
    )


def daily_active_users_bitmaps(
    active: DataFrame, as_of: dt.date | None = None, days: int = 7
) -> DataFrame:
    """The same from the bitmaps of batches (`read_active_users`)."""
    merged = (
        active.where(_since(as_of, days))
        .groupBy("ingest_date", "shard", "bucket")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    return (
        merged.groupBy("ingest_date")
        .agg(F.sum(F.bitmap_count("bits")).alias("daily_active_users"))
        .orderBy(F.desc("ingest_date"))
    )


def purchase_revenue(
    events: DataFrame, as_of: dt.date | None = None, days: int = 30, lenient: bool = False
) -> DataFrame:
    """Purchases and revenue per day.

    Revenue is the exact total of the amounts a decimal holds, plus the total of
    all others as doubles, each rounded to cents. An amount that is not a number
    fails the query; with `lenient` it counts as no amount.
    """
    text = json_value("payload", "$.amount_usd")
    exact = text.rlike(_EXACT_TEXT)
    other = text.try_cast("double") if lenient else text.cast("double")
    decimals = F.round(F.sum(F.when(exact, text.try_cast(EXACT))), 2).cast("double")
    doubles = F.round(F.sum(F.when(~exact, other)), 2)
    return (
        events.where(_since(as_of, days) & (F.col("event_type") == "purchase"))
        .groupBy("ingest_date")
        .agg(
            F.count("*").alias("purchase_count"),
            F.coalesce(decimals + doubles, decimals, doubles).alias("revenue_usd"),
        )
        .orderBy(F.desc("ingest_date"))
    )


def ingest_health(events: DataFrame, as_of: dt.date | None = None, days: int = 3) -> DataFrame:
    """Events per day and job version."""
    return (
        events.where(_since(as_of, days))
        .groupBy("ingest_date", "pipeline_version")
        .agg(F.count("*").alias("total_events"))
        .orderBy(F.desc("ingest_date"))
    )


def top_error_codes(events: DataFrame, as_of: dt.date | None = None, top: int = 10) -> DataFrame:
    """The most frequent error codes of the day; ties in order of the code."""
    return (
        events.where((F.col("event_type") == "error") & (F.col("ingest_date") == _today(as_of)))
        .groupBy(json_value("payload", "$.error_code").alias("error_code"))
        .agg(F.count("*").alias("occurrences"))
        .orderBy(F.desc("occurrences"), F.asc("error_code"))
        .limit(top)
    )


def type_counts(events: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Events of the day per type."""
    return (
        events.where(F.col("ingest_date") == _today(as_of))
        .groupBy("event_type")
        .agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"))
    )


def hourly_volume_rollup(rollup: DataFrame, as_of: dt.date | None = None, days: int = 1) -> DataFrame:
    """`hourly_volume`, from the counts of batches."""
    return (
        rollup.where(_since(as_of, days)).groupBy("hour", "event_type")
        .agg(F.sum("event_count").alias("event_count"))
        .orderBy(F.desc("hour"), F.desc("event_count"))
    )


def ingest_health_rollup(rollup: DataFrame, as_of: dt.date | None = None, days: int = 3) -> DataFrame:
    """`ingest_health`, from the counts of batches."""
    return (
        rollup.where(_since(as_of, days)).groupBy("ingest_date", "pipeline_version")
        .agg(F.sum("event_count").alias("total_events"))
        .orderBy(F.desc("ingest_date"))
    )


def top_error_codes_rollup(rollup: DataFrame, as_of: dt.date | None = None, top: int = 10) -> DataFrame:
    """`top_error_codes`, from the counts of batches."""
    return (
        rollup.where((F.col("event_type") == "error") & (F.col("ingest_date") == _today(as_of)))
        .groupBy("error_code").agg(F.sum("event_count").alias("occurrences"))
        .orderBy(F.desc("occurrences"), F.asc("error_code"))
        .limit(top)
    )


def over_table(
    plan: Callable[..., DataFrame],
    spark: SparkSession,
    root: str,
    as_of: dt.date | None = None,
    **options,
) -> DataFrame:
    """A dashboard query or day check over the stored table at `root`.

    Only the folders of the days that the query reads are listed: the last
    `days`, by its own default unless given, or the day itself.
    """
    day = as_of or spark.sql("SELECT current_date() AS d").first().d
    known = inspect.signature(plan).parameters
    days = options.get("days", known["days"].default if "days" in known else 0)
    until = day if "days" not in known else None
    return plan(read_events(spark, root, day - dt.timedelta(days=days), until), day, **options)
