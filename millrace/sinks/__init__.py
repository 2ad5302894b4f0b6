"""The two tables on disk."""

from millrace.sinks.ids import IDS, read_ids, write_ids, write_new_events
from millrace.sinks.ledger import read_ledger
from millrace.sinks.rollups import ROLLUP, read_rollup, write_rollup
from millrace.sinks.tables import (
    LETTERS_TABLE,
    batch_events,
    clean_up,
    compact_day,
    read_dead_letters,
    read_events,
    table_columns,
    write_batch,
    write_dead_letters,
    write_events,
)
from millrace.sinks.users import ACTIVE, read_active_users, write_active_users

__all__ = [
    "ACTIVE",
    "IDS",
    "LETTERS_TABLE",
    "ROLLUP",
    "batch_events",
    "clean_up",
    "compact_day",
    "read_active_users",
    "read_dead_letters",
    "read_events",
    "read_ids",
    "read_ledger",
    "read_rollup",
    "table_columns",
    "write_active_users",
    "write_batch",
    "write_dead_letters",
    "write_events",
    "write_ids",
    "write_new_events",
    "write_rollup",
]
