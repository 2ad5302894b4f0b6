"""Spark side of the registered queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace import configure, operators, plans
from millrace.functions import json_value
from millrace.session import scratch_dir
from millrace.schemas import EVENTS_RAW
from millrace.sinks import (
    ACTIVE,
    IDS,
    ROLLUP,
    compact_day,
    read_active_users,
    read_dead_letters,
    read_events,
    read_ledger,
    read_rollup,
    write_events,
)
from millrace.sources import (
    generate_envelopes,
    generate_events,
    read_envelopes,
    write_envelopes,
)
from millrace.streaming import (
    IngestJob,
    Session,
    Sliding,
    Tumbling,
    assign_window,
    closed_at,
    counts_by_strategy,
    late_rows,
    session_counts,
    session_counts_by_type,
    sliding_counts,
    start_window_counts,
    tumbling_counts,
    tumbling_with_late_rows,
    with_open_windows,
)
from workload import messages as M

AS_OF = dt.date(2024, 1, 30)
HOUR = 3600
SLIDE = 900
GAP = 1800
TYPE_GAPS = {"page_view": 900, "purchase": 3600}
STRATEGIES = {
    "page_view": Tumbling(60),
    "click": Sliding(HOUR, SLIDE),
    "purchase": Session(GAP),
    "error": Tumbling(60),
}
SEED = 42
LATE_CUT = dt.datetime(2024, 1, 20)

Query = Callable[[SparkSession, str], DataFrame]


def plain(rows: DataFrame) -> DataFrame:
    """UTC timestamps without a zone, the way the SQL side shows them."""
    return rows.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def src_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(configure(spark), "envelopes")
    write_envelopes(M.messages(spark, sf_dir), path)
    return plain(
        read_envelopes(spark, path).agg(
            F.count("value").alias("messages"),
            F.count("attributes.event_type").alias("typed"),
            F.min("publish_time").alias("first_published"),
            F.max("publish_time").alias("last_published"),
        )
    )


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = operators.parse_events(M.messages(spark, sf_dir))
    return parsed.where(F.col("parse_error").isNull()).select(
        "message_id", "event_id", "event_type", "user_id"
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = operators.dead_letters(M.validated(spark, sf_dir))
    return plain(letters.select("publish_time", "reason", "error", "raw"))


def dead_letter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.dead_letter_summary(operators.dead_letters(M.validated(spark, sf_dir)))


def dead_letter_redrive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters again, an id put before their fields: mends those that had none."""
    letters = operators.dead_letters(M.validated(spark, sf_dir))
    patched = F.concat(F.lit('{"event_id":"redriven",'), F.expr("substring(raw, 2)"))
    again = operators.validate_events(operators.parse_events(operators.redrive(letters, patched)))
    return again.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("message_count")
    )


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.good(spark, sf_dir).select("event_id", "event_type")


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.reject_summary(M.validated(spark, sf_dir))


def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(
        M.enriched(spark, sf_dir).select(
            "event_id",
            "event_type",
            "user_id",
            json_value("payload", "$.amount_usd").cast("double").alias("amount_usd"),
            json_value("payload", "$.error_code").alias("error_code"),
            json_value("payload", "$.event_id").alias("core_in_payload"),
            "payload",
            "processed_at",
            "ingest_date",
            "pipeline_version",
        )
    )


def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.conformance_report(M.enriched(spark, sf_dir))


def q1_hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(plans.hourly_volume(M.enriched(spark, sf_dir), AS_OF))


def q2_daily_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.daily_active_users(M.enriched(spark, sf_dir), AS_OF)


def q3_purchase_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.purchase_revenue(M.enriched(spark, sf_dir), AS_OF)


def q4_ingest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.ingest_health(M.enriched(spark, sf_dir), AS_OF)


def q5_top_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.top_error_codes(M.enriched(spark, sf_dir), AS_OF)


def q6_type_counts_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.type_counts(M.enriched(spark, sf_dir), AS_OF)


def q7_quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.quality_check(M.enriched(spark, sf_dir), AS_OF)


def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.quality_report(M.enriched(spark, sf_dir), AS_OF)


def partition_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.partition_ready(M.enriched(spark, sf_dir), AS_OF)


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that runs past the last day of the data."""
    return plans.missing_days(M.enriched(spark, sf_dir), AS_OF + dt.timedelta(days=3), days=6)


def tumbling_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_window(M.good(spark, sf_dir))
    return plain(
        rows.select(
            "event_id",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
        )
    )


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(tumbling_counts(M.good(spark, sf_dir)))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(sliding_counts(M.good(spark, sf_dir), HOUR, SLIDE))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(session_counts(M.good(spark, sf_dir), GAP))


def sessions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(session_counts_by_type(M.good(spark, sf_dir), TYPE_GAPS, GAP))


def window_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(counts_by_strategy(M.good(spark, sf_dir), STRATEGIES))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = M.redelivered(M.messages(spark, sf_dir))
    good = operators.validate_events(operators.parse_events(twice))
    rows = operators.enrich_events(good, clock=F.col("publish_time"))
    return plain(operators.dedup_events(rows).select("event_id", "event_type", "processed_at"))


def json_value_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.events_table(spark, sf_dir).select(
        "event_id",
        json_value("props", "$.k").alias("k"),
        json_value(F.concat(F.lit('{"props":'), "props", F.lit("}")), "$.props").alias("whole"),
        json_value("props", "$.absent").alias("absent"),
    )


def hour_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    return plain(M.events_table(spark, sf_dir).select("event_id", hour.alias("hour")))


def _ingested(spark: SparkSession, sf_dir: str, label: str) -> IngestJob:
    root = scratch_dir(configure(spark), label)
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"))
    stream = M.as_messages(M.events_stream(spark, sf_dir))
    job.start(stream, f"{root}/checkpoint").awaitTermination()
    return job


def sink_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole streaming job, then the table it wrote."""
    job = _ingested(spark, sf_dir, "sink")
    return plain(read_events(spark, job.events_root))


def sink_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _ingested(spark, sf_dir, "letters")
    return operators.dead_letter_summary(read_dead_letters(spark, job.letters_root))


def partition_pruned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(configure(spark), "pruned")
    write_events(M.enriched(spark, sf_dir), root, "load")
    days = read_events(spark, root, AS_OF - dt.timedelta(days=3), AS_OF)
    return days.groupBy("ingest_date", "event_type").agg(F.count("*").alias("event_count"))


def schema_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days before the cut are written without the new column, later ones with it."""
    root = scratch_dir(configure(spark), "evolved")
    rows = M.enriched(spark, sf_dir)
    added = T.StructType([T.StructField("amount_usd", T.DoubleType())])
    amount = json_value("payload", "$.amount_usd").cast("double").alias("amount_usd")
    write_events(rows.where(F.col("processed_at") < F.lit(LATE_CUT)), root, "old")
    newer = rows.where(F.col("processed_at") >= F.lit(LATE_CUT)).select("*", amount)
    write_events(newer, root, "new", extra=added)
    return (
        read_events(spark, root, extra=added)
        .groupBy("ingest_date")
        .agg(
            F.count("*").alias("event_count"),
            F.count("amount_usd").alias("amounts"),
            F.count_if(F.col("amount_usd").isNull()).alias("null_amounts"),
        )
    )


def gen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic event for every row of the table."""
    ids = M.events_table(spark, sf_dir)
    made = generate_events(ids, SEED, clock=F.col("ts").cast("timestamp"), id_column="event_id")
    return plain(made)


def gen_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic messages, judged by the job: all of them must pass."""
    ids = M.events_table(spark, sf_dir)
    made = generate_envelopes(ids, SEED, clock=F.col("ts").cast("timestamp"), id_column="event_id")
    judged = operators.validate_events(operators.parse_events(made))
    return judged.groupBy(
        F.col("attributes.event_type").alias("event_type"),
        F.coalesce("reason", F.lit("accepted")).alias("outcome"),
    ).agg(F.count("*").alias("message_count"))


def _streamed(spark: SparkSession, sf_dir: str, label: str, shape) -> DataFrame:
    """A windowed stream over all messages, run to its end: all its windows.

    What the stream appended, and the windows that were still open.
    """
    out = scratch_dir(configure(spark), label)
    stream = operators.validate_events(
        operators.parse_events(M.as_messages(M.events_stream(spark, sf_dir)))
    )
    rows = shape(operators.accepted(stream), "1 hour")
    query = _drained(rows, out)
    appended = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    counted = shape(M.good(spark, sf_dir), None)
    return plain(with_open_windows(appended, counted, closed_at(query)))


def _drained(rows: DataFrame, out: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "tumbling", lambda rows, late: tumbling_counts(rows, lateness=late)
    )


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "sliding",
        lambda rows, late: sliding_counts(rows, HOUR, SLIDE, lateness=late),
    )


def stream_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "sessions", lambda rows, late: session_counts(rows, GAP, lateness=late)
    )


def stream_session_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "sessions-by-type",
        lambda rows, late: session_counts_by_type(rows, TYPE_GAPS, GAP, lateness=late),
    )


def stream_window_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "strategies",
        lambda rows, late: counts_by_strategy(rows, STRATEGIES, lateness=late),
    )


def stream_strategies_silent_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream itself gives out, beside a strategy for a type that never comes."""
    out = scratch_dir(configure(spark), "silent")
    stream = operators.accepted(operators.validate_events(
        operators.parse_events(M.as_messages(M.events_stream(spark, sf_dir)))))
    plan = STRATEGIES | {"session_start": Session(GAP), "session_end": Tumbling(HOUR)}
    rows = counts_by_strategy(stream, plan, lateness="1 hour")
    _drained(rows, out)
    return plain(spark.read.schema(rows.schema).parquet(f"{out}/rows"))


def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered messages on a stream; which copy stays is not defined."""
    out = scratch_dir(configure(spark), "dedup")
    twice = M.redelivered(M.as_messages(M.events_stream(spark, sf_dir)))
    good = operators.accepted(operators.validate_events(operators.parse_events(twice)))
    rows = operators.dedup_stream(good).select("event_id", "event_type", "user_id")
    _drained(rows, out)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def _phases() -> list[Column]:
    """Messages before the cut, after it, and a tenth of all that comes last."""
    held_back = F.col("message_id").cast("bigint") % 10 == 3
    early = F.col("publish_time") < F.lit(LATE_CUT)
    return [early & ~held_back, ~early & ~held_back, held_back]


def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication where first copies come days behind the newest message."""
    root = scratch_dir(configure(spark), "dedup-late")
    twice = M.redelivered(M.messages(spark, sf_dir))
    for phase in _phases():
        write_envelopes(twice.where(phase), f"{root}/in")
        good = operators.accepted(operators.validate_events(operators.parse_events(
            read_envelopes(spark, f"{root}/in", streaming=True))))
        rows = operators.dedup_stream(good).select("event_id", "event_type", "user_id")
        _drained(rows, root)
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling counts where a tenth of the messages come last, and what that cost.

    Three runs on one checkpoint: messages before the cut, messages after it,
    then the held-back ones, whose windows the watermark has closed unless
    they lie within the allowed lateness of the newest message. Windows that
    were closed at the end are compared with a count of the stored messages.
    """
    root = scratch_dir(configure(spark), "late")
    every = M.messages(spark, sf_dir)
    for phase in _phases():
        write_envelopes(every.where(phase), f"{root}/in")
        query = start_window_counts(
            read_envelopes(spark, f"{root}/in", streaming=True),
            f"{root}/out", f"{root}/state", size=HOUR, lateness="2 days",
        )
        query.awaitTermination()
    counted = tumbling_counts(M.good(spark, sf_dir), HOUR)
    appended = spark.read.schema(counted.schema).parquet(f"{root}/out")
    return plain(late_rows(appended, counted, closed_at(query)))


def sink_batch_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written again: a day later, and with all their rows turned away."""
    root = scratch_dir(configure(spark), "rerun")
    messages = M.messages(spark, sf_dir)
    later = F.col("publish_time") + F.make_dt_interval(days=F.lit(1))

    def job(table: str, **how) -> IngestJob:
        return IngestJob(f"{root}/{table}/events", f"{root}/{table}/letters", **how)

    job("moved", clock=F.col("publish_time")).run_batch(messages, "b")
    job("moved", clock=later).run_batch(messages, "b")
    job("refused", clock=F.col("publish_time")).run_batch(messages, "b")
    job("refused", clock=F.col("publish_time"), event_types=["refund"]).run_batch(messages, "b")
    parts = []
    for table in ("moved", "refused"):
        for side, rows in (
            ("events", read_events(spark, job(table).events_root).select("ingest_date")),
            ("letters", read_dead_letters(spark, job(table).letters_root).select(
                F.to_date("publish_time").alias("ingest_date"))),
        ):
            counted = rows.groupBy("ingest_date").agg(F.count("*").alias("row_count"))
            parts.append(counted.select(
                F.lit(f"{table} {side}").alias("part"), "ingest_date", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def compacted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, two days compacted, and the first batch written again after it."""
    root = scratch_dir(configure(spark), "compacted")
    rows = M.enriched(spark, sf_dir)
    third = F.pmod(F.col("event_id").try_cast("bigint"), F.lit(3))
    for n in range(3):
        write_events(rows.where(third == n), root, f"b{n}")
    for day in (AS_OF, AS_OF - dt.timedelta(days=1)):
        compact_day(spark, root, EVENTS_RAW, day)
    write_events(rows.where(third == 0), root, "b0")
    return plain(read_events(spark, root))


def table_read_during_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that began before a batch moved a day on and a day was compacted, and one after."""
    root = scratch_dir(configure(spark), "rewrite")
    rows = M.enriched(spark, sf_dir)
    third = F.pmod(F.col("event_id").try_cast("bigint"), F.lit(3))
    for n in range(3):
        write_events(rows.where(third == n), root, f"b{n}")
    before = read_events(spark, root)
    moved = rows.where(third == 0).withColumn("ingest_date", F.date_add("ingest_date", 1))
    write_events(moved, root, "b0")
    compact_day(spark, root, EVENTS_RAW, AS_OF)
    return reduce(DataFrame.unionByName, [
        seen.groupBy(F.lit(name).alias("reader"), "ingest_date").agg(F.count("*").alias("row_count"))
        for name, seen in (("before", before), ("after", read_events(spark, root)))])


LOOKUP_TYPES = ["click", "purchase"]
LOOKUP_USERS = [f"user_{n}" for n in range(1, 13)]


def table_user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users' events from a table of which two days are compacted into small files."""
    root = scratch_dir(configure(spark), "lookup")
    write_events(M.enriched(spark, sf_dir), root, "load")
    for day in (AS_OF, AS_OF - dt.timedelta(days=1)):
        compact_day(spark, root, EVENTS_RAW, day, file_bytes=4 << 10)
    found = read_events(spark, root, event_types=LOOKUP_TYPES, users=LOOKUP_USERS)
    return plain(found.select("event_id", "event_type", "user_id", "processed_at", "ingest_date"))


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the columns in one table: none added, one, and that one wider and another."""
    root = scratch_dir(configure(spark), "versions")
    rows = M.enriched(spark, sf_dir)
    code, amount = json_value("payload", "$.error_code"), json_value("payload", "$.amount_usd")
    third = F.pmod(F.col("event_id").try_cast("bigint"), F.lit(3))
    write_events(rows.where(third == 0), root, "v0")
    write_events(rows.where(third == 1).withColumn("error_code", code.cast("int")), root, "v1",
                 extra=T.StructType.fromDDL("error_code int"))
    newest = rows.where(third == 2).withColumn("error_code", code.cast("bigint") + (1 << 40))
    write_events(newest.withColumn("amount_usd", amount.cast("double")), root, "v2",
                 extra=T.StructType.fromDDL("error_code bigint, amount_usd double"))
    compact_day(spark, root, EVENTS_RAW, AS_OF)
    return read_events(spark, root).groupBy("ingest_date").agg(
        F.count("*").alias("event_count"),
        F.count("error_code").alias("codes"),
        F.sum("error_code").alias("code_sum"),
        F.count("amount_usd").alias("amounts"),
    )


def exact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with ids of 45 digits, numbers beyond a double and halves of surrogate pairs."""
    rows = M.events_table(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    kind = F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type"))
    number = F.lpad(F.col("event_id").cast("string"), 44, "0")
    body = F.concat(
        F.lit('{"event_id":1'), number, F.lit(',"event_type":"'), kind, F.lit('","user_id":'),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("7"), number)).otherwise(
            F.concat(F.lit('"user_'), F.col("user_id"), F.lit('"'))),
        F.lit(',"text":"\\ud800 \\\\ud800 \\ud83d'), F.col("event_id"), F.lit('","beyond":[-'), F.col("event_id"),
        F.lit('.50e400,0.'), number, F.lit("]}"))
    sent = rows.select(
        body.cast("binary").alias("value"), F.lit(None).cast("map<string,string>").alias("attributes"),
        F.col("event_id").cast("string").alias("message_id"), F.col("ts").cast("timestamp").alias("publish_time"))
    good = operators.validate_events(operators.parse_events(sent))
    made = operators.enrich_events(good, clock=F.col("publish_time"))
    return plain(made.select("event_id", "event_type", "user_id", "payload", "processed_at"))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that came too late, as the stream gives it out, in the runs of `late_data`."""
    root = scratch_dir(configure(spark), "late-rows")
    every = M.messages(spark, sf_dir)
    for phase in _phases():
        write_envelopes(every.where(phase), f"{root}/in")
        good = operators.accepted(operators.validate_events(operators.parse_events(
            read_envelopes(spark, f"{root}/in", streaming=True))))
        rows = tumbling_with_late_rows(good, HOUR, lateness=2 * 86400, refine=100 * 86400)
        _drained(rows, root)
    found = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    late = found.where("kind = 'late'").select("event_id", "event_type", "publish_time", "window_start", "event_count")
    # Which of a window's late rows comes first is not defined.
    counted = late.withColumn("event_count", F.max("event_count").over(
        Window.partitionBy("event_type", "window_start")))
    return plain(counted)


def stream_sliding_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, "sliding-panes",
        lambda rows, late: sliding_counts(rows, HOUR, SLIDE, lateness=late, panes=True),
    )


def dead_letter_redrive_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters sent round three times: none of them is taken twice."""
    root = scratch_dir(configure(spark), "redrive")
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"))
    job.run_batch(M.messages(spark, sf_dir), "load")
    patched = F.concat(F.lit('{"event_id":"redriven",'), F.expr("substring(raw, 2)"))
    early = dt.date(2000, 1, 1), AS_OF - dt.timedelta(days=20)
    for since, until in (early, (None, None), (None, None)):
        job.redrive(spark, f"{root}/ledger", patched, since, until)
    tried = read_ledger(spark, f"{root}/ledger").groupBy("attempt", "outcome").agg(F.count("*").alias("row_count"))
    redriven = read_events(spark, job.events_root).where("event_id = 'redriven'")
    return tried.unionByName(redriven.agg(
        F.lit(0).cast("long").alias("attempt"), F.lit("in the table").alias("outcome"), F.count("*").alias("row_count")))


def sink_dedup_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in three batches that share copies; the first is written again, a day is compacted.

    A copy comes in a later batch than its first, however long after it.
    """
    root = scratch_dir(configure(spark), "unique")
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"), ids_root=f"{root}/ids")
    messages = M.messages(spark, sf_dir)
    third = F.pmod(F.col("message_id").cast("bigint"), F.lit(3))
    later = F.col("publish_time") + F.make_dt_interval(days=F.lit(2))
    copies = messages.where(F.col("message_id").cast("bigint") % 10 == 0).withColumn("publish_time", later)
    job.run_batch(messages.where(third == 0), "b0")
    job.run_batch(M.redelivered(messages.where(third == 1)).unionByName(copies.where(third == 0)), "b1")
    compact_day(spark, job.events_root, EVENTS_RAW, AS_OF)
    compact_day(spark, job.ids_root, IDS, AS_OF)
    job.run_batch(messages.where(third == 0), "b0")
    job.run_batch(messages.where(third == 2).unionByName(copies.where(third != 2)), "b2")
    return plain(read_events(spark, job.events_root))


def _rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three batches, of which two are written again, one of them after a day was compacted."""
    root = scratch_dir(configure(spark), "rollup")
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"), rollup_root=f"{root}/counts")
    third = F.pmod(F.col("message_id").cast("bigint"), F.lit(3))
    messages = M.messages(spark, sf_dir)
    for n in (0, 1, 2, 0):
        job.run_batch(messages.where(third == n), f"b{n}")
    compact_day(spark, f"{root}/counts", ROLLUP, AS_OF)
    job.run_batch(messages.where(third == 1), "b1")
    return read_rollup(spark, f"{root}/counts", AS_OF - dt.timedelta(days=3), AS_OF)


def q1_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(plans.hourly_volume_rollup(_rolled_up(spark, sf_dir), AS_OF))


def q4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.ingest_health_rollup(_rolled_up(spark, sf_dir), AS_OF)


def q5_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.top_error_codes_rollup(_rolled_up(spark, sf_dir), AS_OF)


def q2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of three batches; one batch first has other messages and is written again, a day is compacted."""
    root = scratch_dir(configure(spark), "users")
    job = IngestJob(f"{root}/events", f"{root}/letters", clock=F.col("publish_time"), users_root=f"{root}/users")
    third = F.pmod(F.col("message_id").cast("bigint"), F.lit(3))
    messages = M.messages(spark, sf_dir)
    job.run_batch(messages.where(third != 0), "b0")
    job.run_batch(messages.where(third == 1), "b1")
    compact_day(spark, f"{root}/users/days", ACTIVE, AS_OF)
    job.run_batch(messages.where(third == 0), "b0")
    job.run_batch(messages.where(third == 2), "b2")
    active = read_active_users(spark, job.users_root, AS_OF - dt.timedelta(days=7), AS_OF)
    return plans.daily_active_users_bitmaps(active, AS_OF)


QUERIES: dict[str, Query] = {
    "src_envelopes": src_envelopes,
    "parse_events": parse_events,
    "dead_letters": dead_letters,
    "dead_letter_summary": dead_letter_summary,
    "dead_letter_redrive": dead_letter_redrive,
    "validate_events": validate_events,
    "reject_summary": reject_summary,
    "enrich_events": enrich_events,
    "schema_conformance": schema_conformance,
    "q1_hourly_volume": q1_hourly_volume,
    "q2_daily_active_users": q2_daily_active_users,
    "q3_purchase_revenue": q3_purchase_revenue,
    "q4_ingest_health": q4_ingest_health,
    "q5_top_error_codes": q5_top_error_codes,
    "q6_type_counts_today": q6_type_counts_today,
    "q7_quality_check": q7_quality_check,
    "dq_report": dq_report,
    "partition_ready": partition_ready,
    "missing_days": missing_days,
    "tumbling_assign": tumbling_assign,
    "tumbling_counts": tumbling,
    "sliding_counts": sliding,
    "session_counts": sessions,
    "session_counts_by_type": sessions_by_type,
    "window_strategies": window_strategies,
    "dedup_events": dedup_events,
    "json_value_extract": json_value_extract,
    "hour_trunc": hour_trunc,
    "sink_events_raw": sink_events_raw,
    "sink_dead_letters": sink_dead_letters,
    "partition_pruned_count": partition_pruned_count,
    "schema_evolution_read": schema_evolution_read,
    "gen_events": gen_events,
    "gen_envelopes": gen_envelopes,
    "stream_tumbling_counts": stream_tumbling_counts,
    "stream_sliding_counts": stream_sliding_counts,
    "stream_session_counts": stream_session_counts,
    "stream_session_counts_by_type": stream_session_counts_by_type,
    "stream_window_strategies": stream_window_strategies,
    "stream_dedup_events": stream_dedup_events,
    "stream_strategies_silent_type": stream_strategies_silent_type,
    "stream_dedup_late": stream_dedup_late,
    "late_data": late_data,
    "sink_batch_rerun": sink_batch_rerun,
    "compacted_days": compacted_days,
    "table_read_during_rewrite": table_read_during_rewrite,
    "table_user_lookup": table_user_lookup,
    "schema_versions": schema_versions,
    "exact_json": exact_json,
    "stream_late_rows": stream_late_rows,
    "stream_sliding_panes": stream_sliding_panes,
    "dead_letter_redrive_twice": dead_letter_redrive_twice,
    "sink_dedup_across_runs": sink_dedup_across_runs,
    "q1_rollup": q1_rollup,
    "q2_incremental": q2_incremental,
    "q4_rollup": q4_rollup,
    "q5_rollup": q5_rollup,
}
