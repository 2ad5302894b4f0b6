"""Repeated passages by sorted suffixes.

A *suffix* here is a byte position of a text with the `LENGTH` bytes from it on.
A byte goes if a string of that length which covers it also starts in a document
with a smaller doc_id; strings are judged on the input.

1. The leading tokens that route a suffix are the two 8-byte tokens, among all
   that lie inside it, with the least hash. Equal suffixes have the same, and
   neighbouring suffixes mostly share it: they travel as one *run* of text
   rather than 50 bytes each.
2. Splitters sampled from the documents cut the range of the routing tokens into
   buckets of about equal load. A token pair never straddles two buckets, so
   there is nothing to compare across their boundaries.
3. First only the routing tokens of each block of documents go to the buckets,
   which answer with one bit each: is it met in two documents? Runs whose tokens
   are not hold no repeat and never travel. Of runs with equal text, a block
   sends those of its smallest document; the others are repeats already.
4. A bucket is sorted locally by multikey quicksort in vector form: suffixes are
   grouped by one 8-byte token after the other, and only groups that still hold
   two documents go on to the next token. What is left after the last token are
   equal suffixes; all but those of the smallest doc_id are repeats.
5. The intervals come back to the blocks and are merged; the other bytes are kept.

Documents are dealt to blocks by a hash once; that exchange serves all steps.
Null texts count as empty. A null doc_id is neither smaller nor greater than
any: its row is kept whole and repeats nothing. Rows are told apart by doc_id
and text, so rows that share an id do not make each other's text a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

LENGTH = 50
TOKEN = 8
# Positions at which a routing token pair may begin inside a suffix.
_SPAN = LENGTH - 2 * TOKEN + 1
# Bytes of text cut into runs at once; a longer text is cut in pieces.
PIECE_BYTES = 2 << 20
# Documents whose routing tokens are sampled for the splitters.
SAMPLE_DOCUMENTS = 2000
SAMPLE_TOKENS = 200_000
BUCKETS_PER_PARTITION = 2
BLOCKS_PER_PARTITION = 1
# Bits of the routing tokens' hash that are asked about; more only cost more.
_ASKED_SHIFT = np.uint64(16)


def _token_view(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, big-endian: they order as the bytes do."""
    n = max(0, len(data) - TOKEN + 1)
    return np.ndarray((n,), dtype=">u8", buffer=data, strides=(1,))


def routing(data: np.ndarray) -> np.ndarray:
    """For each suffix of `LENGTH` bytes, the least hash of the token pairs inside it."""
    view = _token_view(data)
    first = view[: len(data) - 2 * TOKEN + 1].astype(np.uint64)
    second = view[TOKEN : len(data) - TOKEN + 1].astype(np.uint64)
    first *= np.uint64(0x9E3779B97F4A7C15)
    first ^= first >> np.uint64(32)
    first += second
    first *= np.uint64(0xD6E8FEB86659FD93)
    first ^= first >> np.uint64(32)
    least, width = first, 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _SPAN - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about PIECE_BYTES; pieces of a text overlap
    by LENGTH - 1 bytes, so that each suffix lies in one of them."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for offset in range(0, len(text) - LENGTH + 1, PIECE_BYTES):
            piece = text[offset : offset + PIECE_BYTES + LENGTH - 1]
            held.append((row, offset, piece))
            size += len(piece)
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs_of(pieces: list[tuple[int, int, bytes]]
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Runs of suffixes with the same routing: (routing, piece, begin, end) in the joined bytes."""
    joined = b"".join(p for _, _, p in pieces)
    sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    least = routing(np.frombuffer(joined, dtype=np.uint8))
    # A run begins where the routing changes and at the first suffix of a piece;
    # suffixes that straddle two pieces are not suffixes of either.
    change = np.ones(len(least), dtype=bool)
    change[1:] = least[1:] != least[:-1]
    change[begins] = True
    beyond = begins + sizes - LENGTH + 1
    change[beyond[beyond < len(least)]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(least))
    piece = np.searchsorted(begins, at, side="right") - 1
    real = at < beyond[piece]
    at, ends, piece = at[real], ends[real], piece[real]
    return least[at], piece, at, ends + LENGTH - 1, joined


def bucket_splitters(documents: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """buckets - 1 splitters of the routing tokens, from a bounded sample of documents.

    They decide where work is done, never the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            for pieces in _pieces([t.encode() if t else b"" for t in batch.column(text).to_pylist()]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs_of(pieces)[0].view(np.int64))], names=["routing"])

    n = documents.count()
    some = documents.select(text).sample(min(1.0, SAMPLE_DOCUMENTS / max(1, n)), seed=7)
    found = some.mapInArrow(run, "routing long").limit(SAMPLE_TOKENS).toArrow()
    tokens = np.sort(np.asarray(found.column("routing")).astype(np.int64).view(np.uint64))
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64)
    return tokens[np.linspace(0, len(tokens) - 1, buckets + 1).astype(int)[1:-1]]


_RUN = np.dtype([("routing", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("begin", "<i8"), ("size", "<u4")])


def _texts(table: pa.Table) -> list[bytes]:
    """Texts that take part, as bytes; the others as empty."""
    return [t.encode() if t and d is not None else b"" for t, d in zip(
        table.column("_text").to_pylist(), table.column("doc_id").to_pylist())]


def _columns(pieces, docs: np.ndarray, keys: np.ndarray):
    """The runs of some pieces as rows, with where they are in the joined bytes."""
    token, piece, begin, end, joined = runs_of(pieces)
    row = np.array([r for r, _, _ in pieces], dtype=np.int64)
    offset = np.array([o for _, o, _ in pieces], dtype=np.int64)
    sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = np.zeros(len(token), dtype=_RUN)
    rows["routing"] = token
    rows["doc"], rows["key"] = docs[row][piece], keys[row][piece]
    rows["begin"] = begin - starts[piece] + offset[piece]
    rows["size"] = end - begin
    return rows, begin, end, joined


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return (np.asarray(table.column("doc_id").fill_null(0)).astype(np.int64),
            np.asarray(table.column("_key").fill_null(0)).astype(np.int64))


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the stretches of a sorted array."""
    at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), a, b) for a, b in zip(at, at[1:]) if a < b]


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct routing hashes of a block, in order; and which are in two documents of it."""
    docs, keys = _ids(table)
    every, owner = [], []
    for pieces in _pieces(_texts(table)):
        token, piece, _, _, _ = runs_of(pieces)
        row = np.array([r for r, _, _ in pieces], dtype=np.int64)
        every.append(token >> _ASKED_SHIFT)
        owner.append(docs[row][piece])
    if not every:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    token, doc = np.concatenate(every), np.concatenate(owner)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    return token[heads], several


def _questions(splitters: np.ndarray):
    """Per block and bucket: the routing hashes, as differences, and their bits."""
    asked = splitters >> _ASKED_SHIFT

    def run(table: pa.Table) -> pa.Table:
        compress = zstandard.ZstdCompressor(level=3).compress
        block = table.column("_block")[0].as_py()
        token, several = _met(table)
        bucket = np.searchsorted(asked, token, side="right")
        rows = []
        for name, a, b in _cuts(bucket):
            steps = np.diff(token[a:b], prepend=np.uint64(0)).astype("<u8")
            planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
            rows.append((name, block, b - a, compress(planes + np.packbits(several[a:b]).tobytes())))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "block": pa.array([r[1] for r in rows], pa.int32()),
            "n": pa.array([r[2] for r in rows], pa.int32()),
            "blob": pa.array([r[3] for r in rows], pa.binary()),
        })

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each question: a bit per hash, set if it is met in two documents."""
    expand = zstandard.ZstdDecompressor().decompress

    def finish(bucket: int, asked: list[tuple]) -> pa.RecordBatch:
        values, flags = [], []
        for _, n, blob in asked:
            data = np.frombuffer(expand(blob), dtype=np.uint8)
            steps = np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view("<u8").ravel()
            values.append(np.cumsum(steps, dtype=np.uint64))
            flags.append(np.unpackbits(data[8 * n :], count=n).astype(bool))
        every, where = np.unique(np.concatenate(values), return_inverse=True)
        blocks = np.bincount(where, minlength=len(every))
        shared = blocks > 1
        shared[where[np.concatenate(flags)]] = True
        ends = np.cumsum([n for _, n, _ in asked])
        bits = [np.packbits(shared[where[e - n : e]]).tobytes() for (_, n, _), e in zip(asked, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(asked), pa.int32()),
             pa.array([b for b, _, _ in asked], pa.int32()), pa.array(bits, pa.binary())],
            names=["bucket", "_block", "bits"])

    now, asked = None, []
    for batch in batches:
        for bucket, block, n, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "blob"))):
            if bucket != now:
                if asked:
                    yield finish(now, asked)
                now, asked = bucket, []
            asked.append((block, n, blob))
    if asked:
        yield finish(now, asked)


def _sent(splitters: np.ndarray):
    """Runs of a block whose routing is met in two documents, by bucket, and known repeats."""
    asked = splitters >> _ASKED_SHIFT

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        compress = zstandard.ZstdCompressor(level=3).compress
        out = []
        if table.num_rows and answers.num_rows:
            bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
            token, _ = _met(table)
            shared = np.zeros(len(token), dtype=bool)
            for name, a, b in _cuts(np.searchsorted(asked, token, side="right")):
                shared[a:b] = np.unpackbits(np.frombuffer(bits[name], dtype=np.uint8), count=b - a)
            wanted = token[shared]
            docs, keys = _ids(table)
            if len(wanted):
                for pieces in _pieces(_texts(table)):
                    out.append(_batch(pieces, docs, keys, wanted, splitters, compress))
        return pa.Table.from_batches(out, schema=pa.schema(_SENT))

    return run


_SENT = [("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()),
         ("begin", pa.int64()), ("end", pa.int64())]


def _batch(pieces, docs, keys, wanted, splitters, compress) -> pa.RecordBatch:
    rows, begin, end, joined = _columns(pieces, docs, keys)
    asked = rows["routing"] >> _ASKED_SHIFT
    place = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
    shared = wanted[place] == asked
    rows, begin, end = rows[shared], begin[shared], end[shared]

    # Equal runs of the batch: only those of the smallest document travel.
    order = np.lexsort((rows["doc"], rows["size"], rows["routing"]))
    same = np.zeros(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    same[1:] = (rows["routing"][a] == rows["routing"][b]) & (rows["size"][a] == rows["size"][b])
    known = np.zeros(len(rows), dtype=bool)
    group = np.cumsum(~same)
    often = np.flatnonzero(same)
    if len(often):
        firsts: dict[tuple[int, bytes], int] = {}
        members = np.flatnonzero(np.isin(group, np.unique(group[often])))
        for at, g in zip(order[members].tolist(), group[members].tolist()):
            text = joined[begin[at] : end[at]]
            doc = int(rows["doc"][at])
            if firsts.setdefault((g, text), doc) < doc:
                known[at] = True
    sent = np.flatnonzero(~known)
    bucket = np.searchsorted(splitters, rows["routing"][sent], side="right")
    by_bucket = sent[np.argsort(bucket, kind="stable")]
    ids, blobs = [], []
    for name, x, y in _cuts(np.sort(bucket)):
        chosen = by_bucket[x:y]
        text = b"".join([joined[p:q] for p, q in zip(begin[chosen].tolist(), end[chosen].tolist())])
        ids.append(name)
        blobs.append(len(chosen).to_bytes(4, "little") + compress(rows[chosen].tobytes() + text))
    gone = rows[known]
    n, m = len(ids), len(gone)
    nothing, none = [None] * n, [None] * m
    columns = {
        "bucket": ids + none,
        "blob": blobs + none,
        "doc_id": nothing + gone["doc"].tolist(),
        "key": nothing + gone["key"].tolist(),
        "begin": nothing + gone["begin"].tolist(),
        "end": nothing + (gone["begin"] + gone["size"]).tolist(),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kind) for name, kind in _SENT], schema=pa.schema(_SENT))


def repeated_suffixes(tokens: np.ndarray, starts: np.ndarray, doc: np.ndarray,
                      group: np.ndarray) -> np.ndarray:
    """True for suffixes that also start in a smaller document of their group.

    `tokens` holds the 8 bytes from each byte on; suffixes of different groups
    are different. Sorts by one token after the other and drops, at each, what
    is left with one document.
    """
    out = np.zeros(len(starts), dtype=bool)
    left = np.arange(len(starts))
    places = [*range(0, LENGTH - TOKEN, TOKEN), LENGTH - TOKEN]
    for place in places:
        if not len(left):
            return out
        token = tokens[starts[left] + place].astype(np.uint64)
        order = np.lexsort((token, group[left]))
        left, token = left[order], token[order]
        g = group[left]
        new = np.ones(len(left), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (token[1:] != token[:-1])
        label = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[left], heads)
        most = np.maximum.reduceat(doc[left], heads)
        several = (least != most)[label]
        group[left] = label
        if place == places[-1]:
            out[left] = doc[left] > least[label]
        left = left[several]
    return out


def _sort_bucket(blobs: list[bytes], expand) -> Iterator[tuple[np.ndarray, ...]]:
    """Intervals (doc, key, begin, end) of the repeats of one bucket."""
    rows, texts = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        data = expand(blob[4:])
        rows.append(np.frombuffer(data, dtype=_RUN, count=n))
        texts.append(data[n * _RUN.itemsize :])
    run = np.concatenate(rows)
    text = b"".join(texts)
    size = run["size"].astype(np.int64)
    at = np.cumsum(size) - size

    # Only runs whose routing is met in two documents can hold repeats.
    order = np.argsort(run["routing"], kind="stable")
    routing_ = run["routing"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = routing_[1:] != routing_[:-1]
    label = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    doc = run["doc"][order]
    several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    chosen = order[several[label]]
    label = label[several[label]]
    if not len(chosen):
        return

    # Equal runs are one: all but those of its smallest document are repeats.
    least: dict[tuple[int, bytes], int] = {}
    texts_ = [text[a : a + n] for a, n in zip(at[chosen].tolist(), size[chosen].tolist())]
    docs = run["doc"][chosen].tolist()
    keyed = list(zip(label.tolist(), texts_))
    for key, d in zip(keyed, docs):
        if least.get(key, d) >= d:
            least[key] = d
    whole = np.array([least[key] < d for key, d in zip(keyed, docs)], dtype=bool)
    gone = run[chosen[whole]]
    yield gone["doc"], gone["key"], gone["begin"], gone["begin"] + gone["size"]

    chosen, label = chosen[~whole], label[~whole]
    heads = np.flatnonzero(np.diff(label, prepend=-1))
    doc = run["doc"][chosen]
    several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    keep = several[np.cumsum(np.diff(label, prepend=-1) != 0) - 1]
    chosen, label = chosen[keep], label[keep]
    tokens = _token_view(np.frombuffer(text, dtype=np.uint8))
    # Groups are sorted some at a time, so that memory does not grow with a bucket.
    n_suffixes = size[chosen] - LENGTH + 1
    limit = 1 << 19
    begin = 0
    while begin < len(chosen):
        total = np.cumsum(n_suffixes[begin:])
        end = begin + max(1, int(np.searchsorted(total, limit, side="right")))
        while end < len(chosen) and label[end] == label[end - 1]:
            end += 1
        part, n = chosen[begin:end], n_suffixes[begin:end]
        which = np.repeat(np.arange(len(part)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        starts = at[part][which] + step
        found = repeated_suffixes(tokens, starts, run["doc"][part][which],
                                  label[begin:end][which].astype(np.int64))
        # Consecutive repeats of a run are one interval.
        hit = np.flatnonzero(found)
        if len(hit):
            first = np.ones(len(hit), dtype=bool)
            first[1:] = (np.diff(hit) != 1) | (which[hit[1:]] != which[hit[:-1]])
            lasts = np.append(np.flatnonzero(first)[1:] - 1, len(hit) - 1)
            a, b = hit[first], hit[lasts]
            owner = run[part[which[a]]]
            yield owner["doc"], owner["key"], owner["begin"] + step[a], owner["begin"] + step[b] + LENGTH
        begin = end


def _blocks(documents: DataFrame, text: str, blocks: int, partitions: int) -> DataFrame:
    """(doc_id, _key, _text, _block), dealt out by block."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    block = F.pmod(F.xxhash64("doc_id", "_key"), F.lit(blocks)).cast("int")
    return rows.withColumn("_block", block).repartition(partitions, "_block")


def _intervals(dealt: DataFrame, splitters: np.ndarray, partitions: int) -> DataFrame:
    """(doc_id, key, begin, end) of bytes to be removed; intervals may overlap."""
    questions = dealt.groupBy("_block").applyInArrow(
        _questions(splitters), "bucket int, block int, n int, blob binary")
    answers = (
        questions.repartition(partitions, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_answers, "bucket int, _block int, bits binary")
    )
    sent = dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        _sent(splitters),
        "bucket int, blob binary, doc_id long, key long, begin long, end long")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        bucket, blobs = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            for doc, key, begin, end in _sort_bucket(blobs, expand) if blobs else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(x).astype(np.int64)) for x in (doc, key, begin, end)],
                    names=["doc_id", "key", "begin", "end"])

        for batch in batches:
            known = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
            if known.num_rows:
                yield known.select(["doc_id", "key", "begin", "end"])
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if b is None:
                    continue
                if b != bucket:
                    yield from finish()
                    bucket, blobs = b, []
                blobs.append(blob.as_py())
        yield from finish()

    # Intervals that are known already go wherever their own hash says.
    place = F.coalesce("bucket", -1 - F.pmod(F.hash("doc_id", "begin"), F.lit(1 << 20)))
    return (
        sent.repartition(partitions, place).sortWithinPartitions("bucket")
        .mapInArrow(sort, "doc_id long, key long, begin long, end long")
    )


def remove_repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = BLOCKS_PER_PARTITION * partitions
    splitters = bucket_splitters(documents, BUCKETS_PER_PARTITION * partitions, text)
    dealt = _blocks(documents, text, blocks, partitions)
    found = _intervals(dealt, splitters, partitions)
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks)).cast("int")

    def finish(table: pa.Table, intervals: pa.Table) -> pa.Table:
        spans = _by_row(intervals)
        out: list[tuple] = []
        for doc, key, value in zip(table.column("doc_id").to_pylist(), table.column("_key").to_pylist(),
                                   table.column("_text").to_pylist()):
            data = (value or "").encode()
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            for begin, end in merged(*spans[doc, key]) if (doc, key) in spans else ():
                kept.update(data[at:begin])
                at, removed, n = end, removed + end - begin, n + 1
            kept.update(data[at:])
            out.append((doc, len(data), removed, n, kept.hexdigest()))
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds))})

    return dealt.groupBy("_block").cogroup(found.withColumn("_block", block).groupBy("_block")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _by_row(intervals: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Begins and ends of the intervals of each (doc_id, key)."""
    if not intervals.num_rows:
        return {}
    doc, key, begin, end = (
        np.asarray(intervals.column(c)).astype(np.int64) for c in ("doc_id", "key", "begin", "end"))
    order = np.lexsort((end, begin, key, doc))
    doc, key, begin, end = doc[order], key[order], begin[order], end[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.append(np.flatnonzero(new), len(doc)).tolist()
    return {(int(doc[a]), int(key[a])): (begin[a:b], end[a:b]) for a, b in zip(at, at[1:])}


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching intervals, sorted by their begin, made one."""
    end = np.maximum.accumulate(end)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:] - 1, len(begin) - 1)
    return list(zip(begin[heads].tolist(), end[lasts].tolist()))
