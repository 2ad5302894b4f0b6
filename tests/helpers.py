"""Plan text, and running streams to their end."""

from __future__ import annotations


def physical(df) -> str:
    """The plan before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


def drain(rows, out: str, state: str, mode: str = "append"):
    writer = rows.writeStream.format("parquet").outputMode(mode)
    query = (
        writer.option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
