"""Where messages come from."""

from millrace.sources.envelopes import from_kafka, read_envelopes, write_envelopes
from millrace.sources.generator import generate_envelopes, generate_events, start_publishing

__all__ = [
    "from_kafka",
    "generate_envelopes",
    "generate_events",
    "read_envelopes",
    "start_publishing",
    "write_envelopes",
]
