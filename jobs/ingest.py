"""Run the ingestion stream.

    spark-submit --py-files millrace.zip jobs/ingest.py \
        --source <folder> --events <table> --dead-letters <table> --checkpoint <folder>
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace import configure
from millrace.schemas import DEFAULT_VERSION, DEFAULT_WINDOW_SECS, VALID_EVENT_TYPES
from millrace.sources import read_envelopes
from millrace.streaming import IngestJob, start_window_counts


# Input of one micro-batch, so that a backlog is worked off in pieces.
MAX_BYTES = "1g"
# The same for a broker, in messages.
MAX_MESSAGES = "2000000"


def _option(text: str) -> tuple[str, str]:
    key, separator, value = text.partition("=")
    if not separator:
        raise argparse.ArgumentTypeError(f"not key=value: {text}")
    return key, value


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--source", help="folder of message files; none for a broker")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "kafka"])
    parser.add_argument("--option", action="append", default=[], type=_option, metavar="KEY=VALUE",
                        help="option of the source, such as subscribe=<topic>; may be repeated")
    parser.add_argument("--events", required=True, help="root of the events table")
    parser.add_argument("--dead-letters", required=True, help="root of the dead-letter table")
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--rollup", help="root of a table of counts per batch, hour and type, if wanted")
    parser.add_argument("--ids", help="root of an index of event ids: events whose id came before are left out")
    parser.add_argument("--unique-days", type=int, help="days of that index that are looked at; all by default")
    parser.add_argument("--users", help="root of the tables of distinct users per batch, if wanted")
    parser.add_argument("--event-types", default=",".join(VALID_EVENT_TYPES),
                        type=lambda text: tuple(t for t in text.split(",") if t),
                        help="known event types, with commas between them")
    parser.add_argument("--pipeline-version", default=DEFAULT_VERSION)
    parser.add_argument("--interval", help='for example "30 seconds"; default: drain, then stop')
    parser.add_argument("--max-bytes", default=MAX_BYTES, help="bound on the files of one micro-batch")
    parser.add_argument("--partitions", type=int, help="deal the messages out to so many tasks")
    parser.add_argument("--window-secs", type=int, default=DEFAULT_WINDOW_SECS)
    parser.add_argument("--window-counts", help="folder for counts per window, if wanted")
    parser.add_argument("--lateness", default="10 minutes", help="for the window counts")
    args = parser.parse_args(argv)
    if args.format != "kafka" and not args.source:
        parser.error("--source is needed for files")
    return args


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = configure(SparkSession.builder.appName("ingest").getOrCreate())

    def messages():
        options = dict(args.option)
        if args.format == "kafka":
            options.setdefault("includeHeaders", "true")
            options.setdefault("maxOffsetsPerTrigger", MAX_MESSAGES)
        return read_envelopes(
            spark, args.source, args.format, streaming=True, partitions=args.partitions,
            max_bytes=None if args.format == "kafka" else args.max_bytes, options=options,
        )

    job = IngestJob(args.events, args.dead_letters, version=args.pipeline_version,
                    event_types=args.event_types, rollup_root=args.rollup,
                    ids_root=args.ids, unique_days=args.unique_days, users_root=args.users)
    running = [job.start(messages(), f"{args.checkpoint}/events", args.interval, "ingest")]
    if args.window_counts:
        running.append(
            start_window_counts(
                messages(), args.window_counts, f"{args.checkpoint}/windows",
                size=args.window_secs, lateness=args.lateness, interval=args.interval,
                event_types=args.event_types,
            )
        )
    wait(running)


def wait(running: Sequence[StreamingQuery]) -> None:
    """Wait for all streams; when one fails, stop the others and fail."""
    try:
        # Waiting for a query that has failed raises its error.
        while not all([query.awaitTermination(1) for query in running]):
            pass
    finally:
        for query in running:
            query.stop()


if __name__ == "__main__":
    main()
