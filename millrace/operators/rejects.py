"""Dead letters: their shape, their counts, and sending them round again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import REASONS, REQUIRED_COLUMNS


def dead_letter_columns() -> list[Column]:
    """`raw, error, publish_time, reason`; the first two only on rejects."""
    reason = F.col("reason")
    error = F.coalesce(
        F.when(reason == "missing_required", F.concat(F.lit("Missing required fields: "), "missing")),
        *[F.when(reason == name, F.lit(text)) for name, text in REASONS.items()],
    )
    raw = F.when(reason.isNotNull(), F.make_valid_utf8("body"))
    return [raw.alias("raw"), error.alias("error"), F.col("publish_time"), reason]


def dead_letters(validated: DataFrame) -> DataFrame:
    """Rejected messages with the raw text and the reason."""
    return validated.where(F.col("reason").isNotNull()).select(*dead_letter_columns())


def reject_summary(validated: DataFrame) -> DataFrame:
    """Rejects per reason."""
    return (
        validated.where(F.col("reason").isNotNull())
        .groupBy(F.col("reason").alias("reject_reason"))
        .agg(F.count("*").alias("reject_count"))
    )


def dead_letter_summary(letters: DataFrame) -> DataFrame:
    """Dead letters per reason and publish day."""
    return letters.groupBy("reason", F.to_date("publish_time").alias("day")).agg(
        F.count("*").alias("letter_count")
    )


def redrive(letters: DataFrame, repaired: Column | None = None, name: Column | None = None) -> DataFrame:
    """Dead letters as message envelopes again, for another run of the parser.

    `repaired` is the corrected body text; by default the stored one. `name`
    becomes the message id.
    """
    body = F.col("raw") if repaired is None else repaired
    return letters.select(
        body.cast("binary").alias("value"),
        F.create_map(F.lit("redriven_from"), F.col("reason")).alias("attributes"),
        (F.lit(None) if name is None else name).cast("string").alias("message_id"),
        "publish_time",
    )


def conformance_report(events: DataFrame) -> DataFrame:
    """One row: rows, and nulls found in each required column."""
    return events.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED_COLUMNS],
    )
