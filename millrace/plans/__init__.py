"""Queries over the events table."""

from millrace.plans.dashboard import (
    daily_active_users,
    daily_active_users_bitmaps,
    hourly_volume,
    hourly_volume_rollup,
    ingest_health,
    ingest_health_rollup,
    over_table,
    purchase_revenue,
    top_error_codes,
    top_error_codes_rollup,
    type_counts,
)
from millrace.plans.quality import (
    missing_days,
    partition_ready,
    quality_check,
    quality_report,
    require,
)

__all__ = [
    "daily_active_users",
    "daily_active_users_bitmaps",
    "hourly_volume",
    "hourly_volume_rollup",
    "ingest_health",
    "ingest_health_rollup",
    "missing_days",
    "over_table",
    "partition_ready",
    "purchase_revenue",
    "quality_check",
    "quality_report",
    "require",
    "top_error_codes",
    "top_error_codes_rollup",
    "type_counts",
]
