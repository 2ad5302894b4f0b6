"""Check one day of the events table; a failed check fails the job."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from millrace import configure
from millrace.plans import partition_ready, quality_check, quality_report, require
from millrace.sinks import read_events


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--events", required=True, help="root of the events table")
    parser.add_argument("--day", required=True, type=dt.date.fromisoformat)
    parser.add_argument(
        "--any-row", action="store_true",
        help="pass if one complete row exists, even beside rows without an id",
    )
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = configure(SparkSession.builder.appName("daily-check").getOrCreate())
    events = read_events(spark, args.events, args.day, args.day)
    require(partition_ready(events, args.day), f"no data for {args.day}")
    check = quality_check if args.any_row else quality_report
    require(check(events, args.day), f"quality check failed for {args.day}")


if __name__ == "__main__":
    main()
