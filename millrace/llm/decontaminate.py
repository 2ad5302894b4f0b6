"""Benchmark decontamination by a prefix-filtered join of word shingles.

A *window* is ten consecutive words of a benchmark item (an item of fewer words,
but not none, is one window). A document is contaminated by a window that
occurs in it, and every word inside the occurrence is hit.

1. The shingles of a window (up to three words) are ordered by rarity, that is
   by how often they occur in all documents. Containment of the whole window is
   asked for, so one shingle is the necessary prefix: the rarest (ties: the
   first in text order, then the first place).
2. Documents are split once. Places that pass a bit filter of the prefix
   shingles are candidates; each is joined with the windows that have this
   shingle as their prefix. The filter is a bit map of bounded size; what it
   passes wrongly finds no partner in the join.
3. Positional and length bounds: the window must fit between the ends of the
   document when its shingle is laid over the place.
4. The words at the place are compared with the words of the window: exact.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A
null text has no words; items without words have no windows. Items with equal
windows share them. Rows are told apart by doc_id and text: rows that are equal
in both are equal in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, materialise, slices

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
# The bit filter has at most this many bits; more shingles pass more places on.
FILTER_BITS = 1 << 26

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return (text or "").encode().translate(_KEEP).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit number for each run of `size` words (none if there are fewer)."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(hash_word, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def windows_of(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """Distinct windows: window (text), length, shingle, offset, of every shingle of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for at in range(max(0, len(words) - size) + 1 if words else 0):
                    window = words[at : at + size]
                    rows.append((item, b" ".join(window).decode(), len(window)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in
                 enumerate((pa.string(), pa.string(), pa.int32()))],
                names=["item_id", "window", "length"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"),
                         F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "item_id string, window string, length int").distinct()


def _shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, size, shingle, place) for each shingle of each distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "window"):
            out: list[tuple] = []
            for window, length in zip(batch.column("window").to_pylist(),
                                      batch.column("length").to_pylist()):
                size = min(shingle, length)
                for place, h in enumerate(shingle_hashes(window.encode().split(b" "), size)
                                          .view(np.int64).tolist()):
                    out.append((window, length, size, h, place))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
                names=["window", "length", "size", "shingle", "place"])

    return windows.select("window", "length").distinct().mapInArrow(
        run, "window string, length int, size int, shingle long, place int")


def bit_filter(shingles: DataFrame) -> np.ndarray:
    """A bit map of the shingles, about 16 bits for each, at most FILTER_BITS in all."""
    n = shingles.count()
    bits = 64
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    place = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    words = shingles.groupBy(F.shiftright(place, 3).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int")))
        .alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[np.asarray(found.column("byte"))] = np.asarray(found.column("bits")).astype(np.uint8)
    return out


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(filter_) - 1)
    return (filter_[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1


def count_shingles(documents: DataFrame, sizes: list[int], filter_, text: str = "text") -> DataFrame:
    """How often each shingle that passes the filter occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = []
            for value in batch.column(text).to_pylist():
                words = words_of(value)
                for size in sizes:
                    hashes = shingle_hashes(words, size)
                    found.append(hashes[_passes(filter_.value, hashes) > 0])
            if not found:  # no item has a window
                return
            shingles, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles.view(np.int64)), pa.array(n.astype(np.int64))],
                names=["shingle", "n"])

    rows = documents.select(text).mapInArrow(run, "shingle long, n long")
    return rows.groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, documents: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """The rarest shingle of each window: window, length, size, shingle, place."""
    every = materialise(_shingles_of(windows, shingle), "window-shingles")
    sizes = sorted(r[0] for r in every.select("size").distinct().collect())
    spark = documents.sparkSession
    filter_ = spark.sparkContext.broadcast(bit_filter(every.select("shingle").distinct()))
    counts = count_shingles(documents, sizes, filter_, text)
    rarity = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    ranked = every.join(counts, "shingle", "left").withColumn("_r", F.row_number().over(rarity))
    return ranked.where("_r = 1").select("window", "length", "size", "shingle", "place")


def candidates(documents: DataFrame, sizes: list[int], filter_, reach: int, text: str = "text"
               ) -> DataFrame:
    """One row per document: doc_id, its name, n_words, and its candidate places.

    A place holds size and hash of the shingle, its position, and the words from
    `reach` before to `reach` after it, with the number of those before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("_row", pa.string()), ("n_words", pa.int64()),
            ("places", pa.list_(pa.struct([
                ("size", pa.int32()), ("shingle", pa.int64()), ("at", pa.int64()),
                ("before", pa.int32()), ("words", pa.string())]))),
        ])
        for batch in slices(batches, text):
            n_words, places = [], []
            for value in batch.column(text).to_pylist():
                words = words_of(value)
                n_words.append(len(words))
                here = []
                for size in sizes:
                    hashes = shingle_hashes(words, size)
                    for at in np.flatnonzero(_passes(filter_.value, hashes)).tolist():
                        begin = max(0, at - reach)
                        here.append({
                            "size": size, "shingle": int(hashes[at].view(np.int64)), "at": at,
                            "before": at - begin,
                            "words": b" ".join(words[begin : at + reach]).decode(),
                        })
                places.append(here)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), pa.array(n_words, pa.int64()),
                 pa.array(places, schema.field("places").type)], schema=schema)
        give_back()

    return documents.select("doc_id", "_row", text).mapInArrow(
        run,
        "doc_id long, _row string, n_words long, places array<struct<size:int,shingle:long,"
        "at:long,before:int,words:string>>",
    )


def row_name(text: str = "text"):
    """doc_id and a digest of the text, as one text that is never null."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                       F.xxhash64(text).cast("string"))


def contamination(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, _row.

    `_row` names a row by doc_id and a digest of its text, see `row_name`.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            row_name(text).alias("_row"), F.col(text).alias("_text"))
    windows = materialise(windows_of(items, window, shingle), "windows")
    first = materialise(prefixes(windows, docs, shingle, "_text"), "prefixes")
    sizes = sorted(r[0] for r in first.select("size").distinct().collect())
    filter_ = spark.sparkContext.broadcast(bit_filter(first.select("shingle").distinct()))
    scanned = materialise(candidates(docs, sizes, filter_, window, "_text"), "candidates")

    place = (
        scanned.where(F.size("places") > 0)
        .select("_row", "n_words", F.explode(F.array_distinct("places")).alias("p"))
        .select("_row", "n_words", "p.*")
    )
    # Where the window begins, in the document and in the words sent along.
    begin = F.col("at") - F.col("place")
    inner = F.col("before") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("length") <= F.col("n_words")) & (inner >= 0)
    there = F.slice(F.split("words", " "), F.greatest(inner, F.lit(0)) + 1, F.col("length"))
    hits = (
        place.join(first, ["size", "shingle"])
        .where(fits)
        .where(F.array_join(there, " ") == F.col("window"))
        .select("_row", "window", begin.alias("begin"),
                (begin + F.col("length")).alias("end"))
        .distinct()
    )
    hits = materialise(hits, "hits")

    in_order = Window.partitionBy("_row").orderBy("begin", "end").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = hits.groupBy("_row", "begin").agg(F.max("end").alias("end"))
    covered = F.greatest(
        F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(in_order), F.lit(0))))
    n_hit = spans.withColumn("_n", covered).groupBy("_row").agg(F.sum("_n").alias("n_hit"))
    named = (
        hits.select("_row", "window").distinct()
        .join(windows.select("window", "item_id"), "window")
        .select("_row", "item_id").distinct()
        .groupBy("_row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    return scanned.join(n_hit.join(named, "_row"), "_row", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "_row",
    )
