"""Windows over event time, and the ingestion job."""

from millrace.streaming.job import IngestJob, start_window_counts
from millrace.streaming.late import tumbling_with_late_rows
from millrace.streaming.windows import (
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
    tumbling_counts,
    with_open_windows,
)

__all__ = [
    "IngestJob",
    "Session",
    "Sliding",
    "Tumbling",
    "assign_window",
    "closed_at",
    "counts_by_strategy",
    "late_rows",
    "session_counts",
    "session_counts_by_type",
    "sliding_counts",
    "start_window_counts",
    "tumbling_counts",
    "tumbling_with_late_rows",
    "with_open_windows",
]
