"""Which dead letters were sent round again, and what became of them.

The ledger is a table like the others: one row for each letter that was tried, with the
attempt and its outcome. An attempt takes the letters that have no row yet. Its number
is that of the last attempt in the ledger plus one, and names its batch in the events
table: an attempt that broke off before the ledger had it is made again under the same
number and replaces what it wrote. So each letter is accepted once.

A letter goes by a digest of all its columns; letters that are equal in all are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sinks.snapshots import DAY, Table
from millrace.sinks.tables import _read, _replace

ACCEPTED = "accepted"
LEDGER = T.StructType([
    T.StructField("letter", T.StringType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField(DAY, T.DateType()),
])


def letter_digest() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("raw", "error", "publish_time", "reason")]
    return F.sha2(F.concat_ws("\1", *[F.sha2(p, 256) for p in parts]), 256)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """letter, attempt, outcome (`accepted` or the reason it was turned away again), ingest_date."""
    table = Table(spark, root)
    return _read(spark, table, table.snapshot(), LEDGER)


def pending(letters: DataFrame, ledger: DataFrame) -> DataFrame:
    """The letters without a row in the ledger, each once, with their digest as `letter`."""
    each = letters.withColumn("letter", letter_digest()).dropDuplicates(["letter"])
    return each.join(ledger.select("letter"), "letter", "left_anti")


def next_attempt(ledger: DataFrame) -> int:
    return (ledger.agg(F.max("attempt")).first()[0] or 0) + 1


def write_ledger(outcomes: DataFrame, root: str, attempt: int) -> None:
    """Add (or replace) the rows of an attempt: letter, outcome, ingest_date."""
    rows = outcomes.withColumn("attempt", F.lit(attempt).cast("long"))
    _replace(rows.select(*LEDGER.fieldNames()).hint("rebalance", DAY), root, f"redrive-{attempt:09d}", LEDGER)
