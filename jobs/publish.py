"""Publish synthetic messages into the folder a stream reads."""

from __future__ import annotations

import argparse
import secrets
from collections.abc import Sequence

from pyspark.sql import SparkSession

from millrace import configure
from millrace.sources import generate_envelopes, start_publishing, write_envelopes
from millrace.sources.generator import EVENT_TYPES


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True, help="folder the stream reads")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json"])
    parser.add_argument("--count", type=int, default=100)
    parser.add_argument("--seed", type=int, help="repeat a run; default: new events each time")
    parser.add_argument("--event-type", choices=EVENT_TYPES)
    parser.add_argument("--per-second", type=int, help="publish steadily until stopped")
    parser.add_argument("--checkpoint", help="needed with --per-second")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = configure(SparkSession.builder.appName("publish").getOrCreate())
    if args.per_second and not args.checkpoint:
        raise SystemExit("--per-second needs --checkpoint")
    seed = secrets.randbits(62) if args.seed is None else args.seed
    if args.per_second:
        start_publishing(
            spark, args.out, args.checkpoint, args.per_second, seed, args.event_type, args.format
        ).awaitTermination()
        return
    made = generate_envelopes(spark.range(args.count), seed, args.event_type)
    write_envelopes(made, args.out, args.format)


if __name__ == "__main__":
    main()
