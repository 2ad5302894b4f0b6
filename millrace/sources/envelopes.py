"""Message envelopes: body, attributes, id and publish time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import ENVELOPE


def read_envelopes(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | str | None = None,
    partitions: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Envelopes from a source, as a table or as a stream.

    `fmt` is `parquet` or `json` for a folder of envelope files, or `kafka`,
    whose rows are turned into envelopes; `options` are those of the source.
    `partitions` deals the messages out evenly before anything is done with
    them, for sources of few or uneven splits; by default they stay as they are.

    `max_files` or `max_bytes` (a number, or like `1g`) bounds one micro-batch, so that a backlog of any
    size is worked off in pieces that fit the cluster. JSON files carry the
    body in base64.
    """
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**(options or {}))
    if fmt != "kafka":
        reader = reader.schema(ENVELOPE)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if streaming and max_bytes:
        reader = reader.option("maxBytesPerTrigger", _bytes(max_bytes))
    rows = reader.load(path) if path else reader.load()
    rows = from_kafka(rows) if fmt == "kafka" else rows
    return rows.repartition(partitions) if partitions else rows


def _bytes(size: int | str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    text = str(size).strip().lower().removesuffix("b")
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


def write_envelopes(envelopes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Publish: add the messages to the folder a stream reads from."""
    envelopes.select(*ENVELOPE.fieldNames()).write.mode("append").format(fmt).save(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """Envelopes from the rows of Spark's Kafka source.

    Headers are there if the source was asked for them (`includeHeaders`). Of a
    repeated header key the last one counts; headers without a key are left out.
    """
    if "headers" in records.columns:
        later = lambda h, i: F.exists(
            F.slice("headers", i + 2, F.size("headers")), lambda x: x["key"] == h["key"])
        kept = F.filter("headers", lambda h, i: h["key"].isNotNull() & ~F.coalesce(
            later(h, i), F.lit(False)))
        attributes = F.map_from_entries(F.transform(kept, lambda h: F.struct(
            h["key"].alias("key"), h["value"].cast("string").alias("value"))))
    else:
        attributes = F.lit(None).cast("map<string,string>")
    return records.select(
        "value",
        attributes.alias("attributes"),
        F.concat_ws("-", "topic", "partition", "offset").alias("message_id"),
        F.col("timestamp").alias("publish_time"),
    )
