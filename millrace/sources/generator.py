"""Synthetic events, computed from row ids and a seed.

Every value is a function of (seed, id) alone. The same id gives the same event
whatever the partitioning, and again when a lost task is run a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.time import iso_utc
from millrace.schemas import VALID_EVENT_TYPES as EVENT_TYPES
from millrace.sources.envelopes import write_envelopes

# Fixed values of the synthetic events.
PAGES = ("/home", "/products", "/cart", "/checkout", "/account")
REFERRER = "https://google.com"
ERROR_CODES = ("404", "500", "403")
USER_RANGE = (1000, 9999)
PRODUCT_RANGE = (100, 999)
AMOUNT_CENTS = (1000, 50000)


def generate_events(
    ids: DataFrame,
    seed: int = 42,
    event_type: str | None = None,
    clock: Column | None = None,
    id_column: str = "id",
) -> DataFrame:
    """One event per row of `ids` (`spark.range(n)`, a rate stream, a table's keys).

    `event_type` fixes the type; otherwise it is uniform over the six. `clock`
    is the event's timestamp, by default the query's time.
    """
    now = F.current_timestamp() if clock is None else clock
    rows = ids.select(now.alias("now"), F.concat_ws(":", F.lit(seed), id_column).alias("_key"))
    rows = rows.select("now", F.md5("_key").alias("_bits"),
                       F.md5(F.concat("_key", F.lit(":id"))).alias("_uuid"))
    chosen = _pick(EVENT_TYPES, 0) if event_type is None else F.lit(event_type)
    typed = rows.select("*", chosen.alias("event_type"))

    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("event_type") == kind, value)

    return typed.select(
        _uuid4().alias("event_id"),
        "event_type",
        F.concat(F.lit("user_"), _between(USER_RANGE, 1)).alias("user_id"),
        F.col("now").alias("event_time"),
        iso_utc("now").alias("timestamp"),
        only("page_view", _pick(PAGES, 2)).alias("page"),
        only("page_view", F.lit(REFERRER)).alias("referrer"),
        only("purchase", _between(AMOUNT_CENTS, 2) / 100).alias("amount_usd"),
        only("purchase", F.concat(F.lit("prod_"), _between(PRODUCT_RANGE, 3))).alias("product_id"),
        only("error", _pick(ERROR_CODES, 2)).alias("error_code"),
    )


def generate_envelopes(
    ids: DataFrame,
    seed: int = 42,
    event_type: str | None = None,
    clock: Column | None = None,
    id_column: str = "id",
) -> DataFrame:
    """The generated events as published messages, typed by an attribute.

    Fields an event type does not have are absent from the JSON.
    """
    events = generate_events(ids, seed, event_type, clock, id_column)
    body = F.to_json(F.struct(*[c for c in events.columns if c != "event_time"]))
    return events.select(
        body.cast("binary").alias("value"),
        F.create_map(F.lit("event_type"), F.col("event_type")).alias("attributes"),
        F.col("event_id").alias("message_id"),
        F.col("event_time").alias("publish_time"),
    )


def start_publishing(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    per_second: int,
    seed: int = 42,
    event_type: str | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Publish generated messages into a folder at a steady rate, until stopped.

    As with any publisher that retries, a batch may be delivered twice after a
    failure; the copies have the same event ids.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    made = generate_envelopes(ticks, seed, event_type, F.col("timestamp"), "value")

    def publish(batch: DataFrame, _: int) -> None:
        write_envelopes(batch, path, fmt)

    return made.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).start()


def _word(n: int) -> Column:
    """The n-th 32 bits of the row's digest, as a number."""
    return F.conv(F.substring("_bits", 8 * n + 1, 8), 16, 10).cast("bigint")


def _pick(values: tuple[str, ...], word: int) -> Column:
    index = (_word(word) % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def _between(bounds: tuple[int, int], word: int) -> Column:
    low, high = bounds
    return _word(word) % (high - low + 1) + low


def _uuid4() -> Column:
    """Digest in UUID form, with the version and variant bits of a random one."""
    def piece(start: int, length: int) -> Column:
        return F.substring("_uuid", start, length)

    # First digit of the fourth group, by the top two bits.
    variant = F.translate(piece(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-4"), piece(14, 3), F.lit("-"),
        variant, piece(18, 3), F.lit("-"), piece(21, 12),
    )
