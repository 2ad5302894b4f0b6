"""Row operators: DataFrame in, DataFrame out, the same for batch and stream."""

from millrace.operators.dedup import dedup_events, dedup_stream
from millrace.operators.enrich import accepted, enrich_events, rejected, route_messages
from millrace.operators.parse import parse_events
from millrace.operators.rejects import (
    conformance_report,
    dead_letter_summary,
    dead_letters,
    redrive,
    reject_summary,
)
from millrace.operators.validate import validate_events

__all__ = [
    "accepted",
    "conformance_report",
    "dead_letter_summary",
    "dead_letters",
    "dedup_events",
    "dedup_stream",
    "enrich_events",
    "parse_events",
    "redrive",
    "reject_summary",
    "rejected",
    "route_messages",
    "validate_events",
]
