"""Column functions."""

from millrace.functions.json import json_value, parse_one_document, payload_without
from millrace.functions.time import epoch_floor, iso_utc

__all__ = ["epoch_floor", "iso_utc", "json_value", "parse_one_document", "payload_without"]
