"""The `events` table as published messages.

Most rows become good messages; some are broken by rule, so that every route
through the job is taken (first matching rule):

* `event_id % 97 = 0` - the text breaks off
* `event_id % 89 = 0` - no `event_id` key
* `event_id % 83 = 0` - empty `event_id`
* `event_type = 'signup'` - not a known type
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import configure
from millrace.functions import iso_utc
from millrace.operators import accepted, enrich_events, parse_events, validate_events

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since a file stream does not take a single file.
    rows = configure(spark).readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism)


def as_messages(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    identity = F.when(F.col("event_id") % 83 == 0, "").otherwise(F.col("event_id").cast("string"))
    fields = [
        F.when(kind == "view", "page_view").otherwise(kind).alias("event_type"),
        F.concat(F.lit("user_"), "user_id").alias("user_id"),
        iso_utc(_utc("ts")).alias("timestamp"),
        F.when(kind == "purchase", F.col("value")).alias("amount_usd"),
        F.when(kind == "error", F.get_json_object("props", "$.k").cast("int")).alias("error_code"),
    ]
    body = (
        F.when(F.col("event_id") % 97 == 0, '{"event_id": "x')
        .when(F.col("event_id") % 89 == 0, F.to_json(F.struct(*fields)))
        .otherwise(F.to_json(F.struct(identity.alias("event_id"), *fields)))
    )
    return events.select(
        body.cast("binary").alias("value"),
        F.create_map(F.lit("event_type"), kind).alias("attributes"),
        F.col("event_id").cast("string").alias("message_id"),
        _utc("ts").alias("publish_time"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table is one file that cannot be split; parsing is dealt out. Dealt by their
    # columns rows need no sorting to get to the same task in each try.
    rows = events_table(spark, sf_dir)
    return as_messages(rows.repartition(spark.sparkContext.defaultParallelism, *rows.columns))


def redelivered(envelopes: DataFrame) -> DataFrame:
    """The messages, and those whose id is a multiple of 50 a minute later again."""
    copies = F.when(F.col("message_id").cast("bigint") % 50 == 0, 1).otherwise(0)
    later = F.col("publish_time") + F.make_interval(mins=F.col("_copy"))
    return envelopes.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies))).select(
        "value", "attributes", "message_id", later.alias("publish_time")
    )


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_events(parse_events(messages(spark, sf_dir)))


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted messages, still with their publish time."""
    return accepted(validated(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, stamped with the publish time."""
    return enrich_events(validated(spark, sf_dir), clock=F.col("publish_time"))


def _utc(column: str) -> Column:
    return F.col(column).cast("timestamp")
