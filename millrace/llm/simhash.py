"""SimHash near-duplicates by an inverted index of byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at
most two bits differ in at most two bytes, so they share at least six positional
bytes. The index posts each distinct fingerprint under every choice of six
positions with their bytes (28 lists); the tally of shared positional bytes of
two fingerprints that meet in a list is taken, pairs below six are dropped, and
the rest are verified bit by bit. Lists of single bytes would hold a 256th of
all fingerprints each, and their pairs grow with the square of the corpus; a
list of six bytes holds 65,536 distinct fingerprints at most, whatever the
corpus, since only two bytes are left free.

Copies never meet in pairs: rows with the same fingerprint are one entry, with
the smallest doc_id. Words are runs of anything but ASCII white space in the
text with A-Z lower-cased; shingles are three words joined by a space. A text
of fewer words is one shingle; a text without words (or a null one) has
fingerprint zero, which is linked like any other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import with_columns_from
from millrace.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(tokens, tokens[1:], tokens[2:]))
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    hashes = np.fromiter(map(_hash, shingles), dtype=np.uint64, count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for begin in range(0, n, _CHUNK):
        part = hashes[begin : begin + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def with_fingerprints(documents: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """Add the fingerprint of each text, as a signed long with the same bits."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            found = np.array([fingerprint_of(t) for t in column.to_pylist()], dtype=np.uint64)
            return [pa.array(found.view(np.int64))]

        return work

    return with_columns_from(documents, text, [T.StructField(name, T.LongType())], make)


def _byte(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))


def linked_fingerprints(fingerprints: DataFrame, name: str = "_fp", max_bits: int = MAX_BITS
                        ) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `max_bits` bits.

    `fingerprints` must be distinct. A pair may come several times, once for
    each list it meets in.
    """
    shared = 8 - max_bits
    masks = []
    for k, kept in enumerate(combinations(range(8), shared)):
        mask = sum(255 << (8 * i) for i in kept)
        mask = mask - (1 << 64) if mask >> 63 else mask
        masks.append(F.struct(F.lit(k).alias("list"),
                              F.col(name).bitwiseAND(F.lit(mask)).alias("bytes")))
    posted = fingerprints.select(F.col(name).alias("fp"), F.inline(F.array(*masks)))
    left = posted.select(F.col("fp").alias("a"), "list", "bytes")
    right = posted.select(F.col("fp").alias("b"), "list", "bytes")
    a, b = F.col("a"), F.col("b")
    tally = sum((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8))
    # Spark takes the postings for as large as the fingerprints, a 28th of what they are,
    # and would broadcast them.
    return (
        left.join(right.hint("merge"), ["list", "bytes"])
        .where((a < b) & (tally >= shared) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits))
        .select("a", "b")
    )


def with_roots(documents: DataFrame, name: str = "_fp", root: str = "_root") -> DataFrame:
    """Add the smallest fingerprint reachable through links: a component's own name.

    Rows without an id, and components that share an id, have it like any other.
    """
    prints = documents.select(name).distinct()
    roots = connected_components(linked_fingerprints(prints, name)).withColumnsRenamed(
        {"node": name, "root": root})
    return documents.join(roots, name, "left").withColumn(root, F.coalesce(root, name))


def with_components(documents: DataFrame, id_col: str = "doc_id", name: str = "_fp",
                    component: str = "_component") -> DataFrame:
    """Add the smallest id reachable through links of fingerprints, itself included.

    Rows without an id have component null unless a row they reach has one.
    """
    firsts = documents.groupBy(name).agg(F.min(id_col).alias("_first"))
    joined = with_roots(firsts, name)
    least = joined.groupBy("_root").agg(F.min("_first").alias(component))
    labels = joined.select(name, "_root").join(least, "_root").select(name, component)
    return documents.join(labels, name)


def near_duplicates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    from millrace.llm.common import materialise

    marked = materialise(
        with_fingerprints(documents.select("doc_id", F.col(text).alias("_text")), "_text")
        .select("doc_id", "_fp"),
        "fingerprints",
    )
    found = with_components(marked)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
