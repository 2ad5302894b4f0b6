"""Domain checks on parsed events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schemas import VALID_EVENT_TYPES


def validate_events(
    parsed: DataFrame, event_types: Iterable[str] = VALID_EVENT_TYPES
) -> DataFrame:
    """Add `reason`: NULL for a good event, else why it is turned away.

    Carries over `parse_error`; then the type is tested, then the id, then the
    user, and the first failure names the row.
    """
    known = F.coalesce(F.col("event_type").isin(*event_types), F.lit(False))
    reason = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(~known, "unknown_event_type")
        .when(F.col("event_id").isNull(), "bad_event_id")
        .when(~F.col("user_is_scalar"), "bad_user_id")
    )
    return parsed.withColumn("reason", reason)
