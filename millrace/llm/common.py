"""Helpers shared by the operators: stage tables, batches of bounded size, row maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.session import scratch_dir

# Text handled at once by a Python task, unless a single row is longer.
BATCH_BYTES = 8 << 20


def materialise(rows: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Cuts the lineage: a lost executor costs a read of the table, not a rerun
    of what made it.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, f"llm-{label}")
    rows.write.parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def give_back() -> None:
    """Return freed memory to the system at the end of a task.

    A worker process serves many tasks; what its allocators keep of the largest
    one would otherwise add up with what the next one needs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def with_columns_from(
    rows: DataFrame,
    column: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    batch_bytes: int = BATCH_BYTES,
    keep_column: bool = True,
) -> DataFrame:
    """Add `fields`, computed batch by batch from the values of one column.

    `make` runs once per task and returns the function for a batch. A column of
    `rows` that has the name of a new field is replaced. Without `keep_column` the
    column itself is left out.
    """
    names = {f.name.lower() for f in fields}
    kept = rows.select(*[rows[c] for c in rows.columns if c == column or c.lower() not in names])
    schema = T.StructType(
        [f for f in kept.schema.fields
         if f.name.lower() not in names and (keep_column or f.name != column)] + list(fields))
    old = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        target = arrow_schema(schema)
        for batch in slices(batches, column, batch_bytes):
            new = work(batch.column(column))
            arrays = [batch.column(n) for n in old] + list(new)
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)],
                schema=target,
            )
            del batch, new, arrays
        del work
        give_back()

    return kept.mapInArrow(run, schema)


def free_names(rows: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, or longer ones where `rows` has such columns of its own."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
