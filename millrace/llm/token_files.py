"""Token ids in fixed-width bit-packed files.

Each id takes the bits that the largest id of the vocabulary needs. A file
holds, in this order:

* the ids in blocks of `block_tokens` (the last may hold fewer), each block the
  little-endian stream of its ids' bits, filled up to whole bytes;
* an index: the byte offset of each block and of the end (unsigned 64-bit), the
  doc_ids (signed 64-bit), a byte per document that is 1 if its doc_id is null,
  and the number of ids before each document's end (unsigned 64-bit);
* a trailer of 48 bytes: `TOKBITS1`, then width, block_tokens, number of blocks,
  of documents and of ids (unsigned 64-bit each).

Any range of ids is read by seeking to its blocks and unpacked by numpy. Files
follow each other in ascending doc_id order (nulls first; rows that share an id
in the order of their texts), each being one range of doc_ids and beginnings of
texts, so that rows of one id, or of none, lie in as many files as they need unless
their texts begin alike. A task writes under a name of its own and reports it: files
of failed or repeated attempts are never listed, so a lost executor leaves no
half-written file in the result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import WordCodec, default_tokenizer
from millrace.llm.common import materialise, slices
from millrace.session import scratch_dir

MAGIC = b"TOKBITS1"
_TRAILER = "<8s5Q"
_TRAILER_BYTES = struct.calcsize(_TRAILER)
BLOCK_TOKENS = 1 << 14
READ_TOKENS = 1 << 20
# Text encoded at once; more repeats of a word in it are looked up together.
ENCODE_BYTES = 12 << 20
# Characters of a text by which rows of one doc_id are dealt to files.
SPLIT_CHARS = 32
# Words remembered by a worker, where no table of frequent words comes with a task.
CACHE_WORDS = 300_000
# The codec of this process, by its tokenizer's file as it is: a worker serves many tasks.
_KEPT: dict[tuple[str, int, int], WordCodec] = {}


def bit_width(vocabulary: int) -> int:
    """Bits that every id below `vocabulary` fits in."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little")
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    return (bits.reshape(n, width).astype(np.uint64) @ weights).astype("<u4")


class TokenFileWriter:
    """Writes documents one after the other; memory: one block and the index."""

    def __init__(self, sink, width: int, block_tokens: int = BLOCK_TOKENS) -> None:
        self._sink, self._width, self._block = sink, width, block_tokens
        self._open: list[np.ndarray] = []
        self._held, self._bytes = 0, 0
        self._blocks = [0]
        self._docs: list[int | None] = []
        self._ends: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        self._docs.append(doc_id)
        self._ends.append(self.tokens)
        self._open.append(ids)
        self._held += len(ids)
        if self._held >= 8 * self._block:
            self._flush(self._held // self._block * self._block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._open) if self._open else np.zeros(0, dtype="<u4")
        for begin in range(0, n, self._block):
            data = pack(ids[begin : min(begin + self._block, n)], self._width)
            self._sink.write(data)
            self._bytes += len(data)
            self._blocks.append(self._bytes)
        self._open, self._held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self._held)
        nulls = np.array([d is None for d in self._docs], dtype=np.uint8)
        self._sink.write(np.array(self._blocks, dtype="<u8").tobytes())
        self._sink.write(np.array([d or 0 for d in self._docs], dtype="<i8").tobytes())
        self._sink.write(nulls.tobytes())
        self._sink.write(np.array(self._ends, dtype="<u8").tobytes())
        self._sink.write(struct.pack(_TRAILER, MAGIC, self._width, self._block, len(self._blocks) - 1,
                                       len(self._docs), self.tokens))


class TokenFile:
    """Random access to the ids of a file opened for reading."""

    def __init__(self, source) -> None:
        self._source = source
        size = source.size()
        source.seek(size - _TRAILER_BYTES)
        magic, self.width, self.block_tokens, blocks, docs, self.tokens = struct.unpack(
            _TRAILER, source.read(_TRAILER_BYTES))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - _TRAILER_BYTES - 8 * (blocks + 1) - 17 * docs)
        self._offsets = np.frombuffer(source.read(8 * (blocks + 1)), dtype="<u8")
        ids = np.frombuffer(source.read(8 * docs), dtype="<i8").tolist()
        nulls = source.read(docs)
        self.doc_ids = [None if null else i for i, null in zip(ids, nulls)]
        self.ends = np.frombuffer(source.read(8 * docs), dtype="<u8").astype(np.int64)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the file."""
        if begin >= end:
            return np.zeros(0, dtype="<u4")
        first, last = begin // self.block_tokens, (end - 1) // self.block_tokens
        offsets = self._offsets[first : last + 2].astype(np.int64)
        self._source.seek(int(offsets[0]))
        data = self._source.read(int(offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        parts = []
        for i, block in enumerate(range(first, last + 1)):
            n = min(self.block_tokens, self.tokens - block * self.block_tokens)
            parts.append(unpack(data[offsets[i] : offsets[i + 1]], n, self.width))
        skip = first * self.block_tokens
        return np.concatenate(parts)[begin - skip : end - skip]


def kept_codec(tokenizer: str) -> WordCodec:
    """The codec of this process, with the words that earlier tasks have met."""
    about = os.stat(tokenizer)
    key = tokenizer, about.st_mtime_ns, about.st_size
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordCodec(tokenizer, cache_words=CACHE_WORDS)
    return _KEPT[key]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    documents: DataFrame,
    root: str,
    tokenizer: str | None = None,
    end_id: int | None = None,
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Encode each text (null counts as empty), add `end_id`, and write the files.

    Returns the manifest, one row per file: shard, path, docs, tokens.
    """
    tokenizer = tokenizer or default_tokenizer()
    closing = np.array([] if end_id is None else [end_id], dtype="<u4")
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(),
                            F.substring("_text", 1, SPLIT_CHARS).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_text").asc_nulls_first())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        shard = TaskContext.get().partitionId()
        width = bit_width(max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1))
        codec = kept_codec(tokenizer)
        writer = sink = path = None
        docs = 0
        for batch in slices(batches, "_text", ENCODE_BYTES):
            if writer is None:
                files, folder = _filesystem(root)
                files.create_dir(folder, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}.tokbits"
                path = f"{root}/{name}"
                sink = files.open_output_stream(f"{folder}/{name}")
                writer = TokenFileWriter(sink, width, block_tokens)
            docs += batch.num_rows
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(),
                                      codec.encode(batch.column("_text")).to_pylist()):
                writer.add(doc_id, np.concatenate([np.frombuffer(packed, dtype="<u4"), closing]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "path": [path],
                 "docs": pa.array([docs], pa.int64()),
                 "tokens": pa.array([writer.tokens], pa.int64())})

    manifest = ordered.mapInArrow(write, "shard long, path string, docs long, tokens long")
    return materialise(manifest, "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it, in all files. The window
    below runs over the manifest, which has one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("_base").to_pylist()):
                files, inner = _filesystem(path)
                with files.open_input_file(inner) as source:
                    yield from _documents(TokenFile(source), base)

    # A task per file, whatever the few bytes of the manifest are.
    spread = files.select("path", "_base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
    ends = file.ends
    begins = np.concatenate([[0], ends[:-1]])
    i = 0
    while i < len(ends):
        # As many whole documents as fit a read; a longer one is read alone.
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + READ_TOKENS, side="right")))
        crcs = []
        if j == i + 1:
            crc = 0
            for at in range(int(begins[i]), int(ends[i]), READ_TOKENS):
                ids = file.read(at, min(at + READ_TOKENS, int(ends[i])))
                crc = zlib.crc32(ids.tobytes(), crc)
            crcs.append(crc)
        else:
            data = memoryview(file.read(int(begins[i]), int(ends[j - 1])).tobytes())
            for a, b in zip((begins[i:j] - begins[i]).tolist(), (ends[i:j] - begins[i]).tolist()):
                crcs.append(zlib.crc32(data[4 * a : 4 * b]))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(file.doc_ids[i:j], pa.int64()),
            "start": pa.array(begins[i:j] + base, pa.int64()),
            "n_tokens": pa.array(ends[i:j] - begins[i:j], pa.int64()),
            "ids_crc32": pa.array(crcs, pa.int64()),
        })
        i = j


def token_folder(documents: DataFrame) -> str:
    """A fresh folder for token files in the shared folder of the session."""
    return scratch_dir(documents.sparkSession, "token-files")
