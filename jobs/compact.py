"""Compact days of a table, and remove what has not been part of it for some time."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from millrace import configure
from millrace.schemas import EVENTS_RAW
from millrace.sinks import LETTERS_TABLE, clean_up, compact_day


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--table", required=True, help="root of the table")
    parser.add_argument("--dead-letters", action="store_true", help="it is a dead-letter table")
    parser.add_argument("--day", default=[], action="append", type=dt.date.fromisoformat,
                        help="a day to compact; may be repeated")
    parser.add_argument("--keep-hours", type=float,
                        help="remove folders that have not been part of the table for so long")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = configure(SparkSession.builder.appName("compact").getOrCreate())
    schema = LETTERS_TABLE if args.dead_letters else EVENTS_RAW
    for day in args.day:
        compact_day(spark, args.table, schema, day)
    if args.keep_hours is not None:
        clean_up(spark, args.table, dt.timedelta(hours=args.keep_hours))


if __name__ == "__main__":
    main()
