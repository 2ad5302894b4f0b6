"""Declared schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The event types a message may carry.
VALID_EVENT_TYPES = (
    "page_view",
    "click",
    "purchase",
    "session_start",
    "session_end",
    "error",
)

# Fields of a message that become columns; every other field goes to `payload`.
CORE_FIELDS = ("event_id", "event_type", "user_id")

DEFAULT_VERSION = "1.0.0"
DEFAULT_WINDOW_SECS = 60

# A message as it comes from the stream: body bytes plus transport metadata.
ENVELOPE = T.StructType(
    [
        T.StructField("value", T.BinaryType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("message_id", T.StringType()),
        T.StructField("publish_time", T.TimestampType()),
    ]
)

# The analytics table. `payload` is JSON text on disk.
EVENTS_RAW = T.StructType(
    [
        T.StructField("event_id", T.StringType(), nullable=False),
        T.StructField("event_type", T.StringType(), nullable=False),
        T.StructField("user_id", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("processed_at", T.TimestampType(), nullable=False),
        T.StructField("ingest_date", T.DateType(), nullable=False),
        T.StructField("pipeline_version", T.StringType(), nullable=False),
    ]
)

REQUIRED_COLUMNS = tuple(f.name for f in EVENTS_RAW.fields if not f.nullable)

DEAD_LETTER = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("publish_time", T.TimestampType()),
        T.StructField("reason", T.StringType()),
    ]
)

# Why a message was turned away, and the text stored beside it.
REASONS = {
    "bad_utf8": "Message body is not valid UTF-8",
    "too_large": "Message body is beyond the limits of the parser",
    "malformed": "Message body is not one JSON document",
    "not_an_object": "JSON document is not an object",
    "missing_required": "Missing required fields",
    "null_publish_time": "Message has no publish time",
    "unknown_event_type": "Unknown event_type",
    "bad_event_id": "Empty or non-scalar event_id",
    "bad_user_id": "Non-scalar user_id",
    "required_null": "Null in a required column",
}
