"""Source divergence audit by chunk factorization.

How far is what a source says from what other sources of its language say, and by
which terms? Terms are runs of ASCII letters and non-ASCII characters, A-Z
lower-cased. Each language keeps the terms in at least `least_docs` of its
documents, and each of its sources gives each kept term a smoothed share.

1. *Chunks per document.* A text is cut at ASCII white space and the chunks of each
   document are counted. Documents are dealt into parts of bounded size; a part's
   counts are posted per chunk: which of its documents hold the chunk, how often.
   A chunk of more than `CHUNK_BYTES` is cut where no term can go on.
2. *Each distinct chunk once.* Chunks repeat far more than texts, so the terms of a
   chunk are taken once for all documents of the corpus. A term whose chunks' document
   counts add up to less than `least_docs` cannot be kept and goes no further.
3. *Terms back.* Postings meet the terms of their chunk in a join. "the", "the," and
   "(the" are three chunks of one term, so the postings of a part are merged per term:
   that gives distinct documents and occurrences by source, which are summed over parts.
4. *Divergence.* Shares are compared in exact integer arithmetic. Terms of a language
   are dealt into buckets whose dense block of shares, terms by sources, is bounded.

A part's directory, the language and source of its documents, travels to the few
buckets its terms are merged in; so no table of all sources or documents is ever in
one place. In between, sources go by a 64-bit hash; one without collisions is taken.
Null text, language and source are read as ''. An empty text has no terms but its
(language, source) takes part. Every row is a document: rows that are equal count as
often as they come.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, materialise, slices

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# A part has at most so many documents (they are numbered in 16 bits), and is
# closed when it holds so many postings, or bytes of different chunks.
PART_DOCS = (1 << 16) - 1
PART_POSTINGS = 4 << 20
PART_BYTES = 32 << 20
CHUNK_BYTES = 256
# Bits of the filter that spares postings of chunks without a possible term the way to the join.
FILTER_BITS = 1 << 25
# The terms of a part are merged in so many tasks.
PART_BUCKETS = 4
# Entries of a dense block of shares.
BLOCK = 1 << 18

_TERM_BYTES = bytes(
    c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def chunk_counts(text: str | None) -> Counter[bytes]:
    """How often each chunk of a text comes, as lower-cased UTF-8."""
    found = Counter((text or "").encode().lower().split())
    if found and max(map(len, found)) > CHUNK_BYTES:
        for chunk in [c for c in found if len(c) > CHUNK_BYTES]:
            n = found.pop(chunk)
            for piece, m in Counter(chunk.translate(_TERM_BYTES).split()).items():
                found[piece] += n * m
    return found


class _Part:
    """The postings of some documents: for each chunk, which of them hold it and how often."""

    def __init__(self) -> None:
        # A chunk that is asked for the first time gets the next number.
        self.chunks: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.bytes = 0
        self.postings = 0
        self.docs: list[tuple[str, int]] = []
        self.which: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, text: str | None, lang: str, source: int) -> None:
        counts = chunk_counts(text)
        known, before = self.chunks, len(self.chunks)
        self.which.append(np.fromiter(map(known.__getitem__, counts), dtype=np.int32, count=len(counts)))
        self.times.append(np.fromiter(counts.values(), dtype=np.int32, count=len(counts)))
        self.bytes += sum(map(len, islice(reversed(known), len(known) - before)))
        self.postings += len(counts)
        self.docs.append((lang, source))

    def full(self) -> bool:
        return (len(self.docs) >= PART_DOCS or self.postings >= PART_POSTINGS
                or self.bytes >= PART_BYTES)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """One row without a chunk, the directory; then one for each chunk."""
        numbers: dict[tuple[str, int], int] = {}
        group_of = [numbers.setdefault(d, len(numbers)) for d in self.docs]
        head = json.dumps([list(numbers), group_of]).encode()
        yield _posting_batch([part], [None], [0], pa.array([head], pa.binary()))
        if not self.chunks:
            return
        doc = np.repeat(np.arange(len(self.docs), dtype=np.uint16), [len(w) for w in self.which])
        which, times = np.concatenate(self.which), np.concatenate(self.times)
        order = _order(which)
        doc, which, times = doc[order], which[order], times[order]
        docs = np.bincount(which, minlength=len(self.chunks))
        at, times = _in_steps(times, 255)
        doc, which = doc[at], which[at]
        ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(docs)))])
        # Differences of neighbours are small numbers and compress well.
        doc[1:] -= doc[:-1].copy()
        first = ends[:-1]
        doc[first] = np.cumsum(doc, dtype=np.uint16)[first]
        chunks = list(self.chunks)
        for i in range(0, len(chunks), 1 << 15):
            j = min(len(chunks), i + (1 << 15))
            some = ends[i : j + 1]
            yield _posting_batch(
                [part] * (j - i), chunks[i:j], docs[i:j],
                _squeezed(doc[some[0] : some[-1]], times[some[0] : some[-1]], np.diff(some)))


def _in_steps(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which number each step belongs to, and the steps: positive numbers as sums of at most `most`."""
    copies = (n + (most - 1)) // most
    if not len(n) or copies.max() <= 1:
        return np.arange(len(n)), n
    at = np.repeat(np.arange(len(n)), copies)
    steps = np.full(len(at), most, dtype=n.dtype)
    steps[np.cumsum(copies) - 1] = n - most * (copies - 1)
    return at, steps


def _packed(values: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """Binary values, each the bytes of a stretch of `values`."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(ends) - 1,
        [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _places(ends: np.ndarray, sizes: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Where `sizes[i]` bytes lie that begin `shift[i]` after the beginning of row i."""
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(ends[:-1] + shift, sizes) + inner


def _squeezed(doc: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Postings row by row: a byte that says what follows, the low bytes of `doc`, then its
    high bytes and `times` unless all are 0 and all are 1."""
    first = np.cumsum(sizes) - sizes
    high = np.maximum.reduceat(doc, first) > 255
    many = np.maximum.reduceat(times, first) > 1
    ends = np.concatenate([[0], np.cumsum(1 + sizes * (1 + high + many))])
    out = np.zeros(ends[-1], dtype=np.uint8)
    out[ends[:-1]] = high + 2 * many
    out[_places(ends, sizes, 1)] = doc & 255
    of = np.repeat(high, sizes)
    out[_places(ends, sizes * high, 1 + sizes)] = doc[of] >> 8
    of = np.repeat(many, sizes)
    out[_places(ends, sizes * many, 1 + sizes * (1 + high))] = times[of]
    return _packed(out, ends, 1)


def _expanded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, times, sizes) of what `_squeezed` made."""
    data, lengths = _unpacked(column, np.uint8)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    high, many = data[ends[:-1]] & 1, data[ends[:-1]] >> 1
    sizes = (lengths - 1) // (1 + high + many)
    doc = data[_places(ends, sizes, 1)].astype(np.int64)
    doc[np.repeat(high > 0, sizes)] += data[_places(ends, sizes * high, 1 + sizes)].astype(np.int64) << 8
    times = np.ones(len(doc), dtype=np.int64)
    times[np.repeat(many > 0, sizes)] = data[_places(ends, sizes * many, 1 + sizes * (1 + high))]
    return doc, times, sizes


def _posting_batch(part, chunk, docs, postings: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(chunk, pa.binary()), pa.array(docs, pa.int64()), postings],
        names=["part", "chunk", "docs", "postings"])


def postings(documents: DataFrame) -> DataFrame:
    """Chunk counts of each document (text, lang, sid), posted by part and chunk."""
    # Parts of different tasks must not share a number.
    named = documents.select("text", "lang", "sid", F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = _Part(), 0
        for batch in slices(batches, "text"):
            for row, t, lang, sid in zip(*[batch.column(c).to_pylist() for c in ("row", "text", "lang", "sid")]):
                if not part.docs:
                    number = row
                part.add(t, lang, sid)
                if part.full():
                    yield from part.rows(number)
                    part = _Part()
        if part.docs:
            yield from part.rows(number)
        del part
        give_back()

    return named.mapInArrow(run, "part long, chunk binary, docs long, postings binary")


def terms_of_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk, docs, term, m): the terms of each distinct chunk, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, m = [], [], []
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                found = chunk.translate(_TERM_BYTES).split()
                if len(found) == 1:
                    at.append(i)
                    terms.append(found[0])
                    m.append(1)
                    continue
                for term, n in Counter(found).items():
                    at.append(i)
                    terms.append(term)
                    m.append(n)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk").take(at), batch.column("docs").take(at),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(m, pa.int32())],
                names=["chunk", "docs", "term", "m"])

    return chunks.select("chunk", "docs").mapInArrow(run, "chunk binary, docs long, term string, m int")


def term_counts(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, times, sources, counts) of the terms in at least `least_docs` documents.

    `documents` has text, lang and sid, a source's number. `docs` and `times` are a
    term's documents and occurrences in its language; `sources` and `counts` are
    64-bit numbers one after the other, its occurrences by source.
    """
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = materialise(postings(documents), "chunk-postings", "zstd")
    counted = posted.where("chunk IS NOT NULL")
    # A part has a chunk once, so there is nothing to add up before the exchange.
    dealt = counted.select("chunk", "docs").repartition(partitions, "chunk")
    chunks = dealt.groupBy("chunk").agg(F.sum("docs").alias("docs"))
    terms = materialise(terms_of_chunks(chunks), "chunk-terms", "zstd")
    possible = terms.groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = materialise(
        terms.select("chunk", "term", "m").join(possible.select("term"), "term", "left_semi"), "chunk-possible", "zstd")

    # A part's buckets, as one number.
    bucket = (F.col("part") * PART_BUCKETS + F.pmod(F.xxhash64("term"), F.lit(PART_BUCKETS))).alias("bucket")
    met = _probably_in(counted, terms).select("part", "chunk", "postings").join(terms, "chunk").select(bucket, "term", "m", "postings")
    heads = posted.where("chunk IS NULL").select(
        F.explode(F.sequence(F.col("part") * PART_BUCKETS, F.col("part") * PART_BUCKETS + PART_BUCKETS - 1)).alias("bucket"),
        F.lit(None).cast("string").alias("term"), F.lit(0).alias("m"), "postings")
    merged = (
        met.union(heads).repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", F.col("term").asc_nulls_first())
        .mapInArrow(_merge, "lang string, term string, cells binary")
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = yield from _added(_after(rest, batch), least_docs, False)
        if rest is not None:
            yield from _added(rest, least_docs, True)
        give_back()

    return merged.repartition(partitions, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        add_up, "lang string, term string, docs long, times long, sources binary, counts binary")


def _probably_in(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings whose chunk's bit is set: all of chunks that have terms, and a few more."""
    bit = F.pmod(F.xxhash64("chunk"), F.lit(FILTER_BITS))
    bits = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bits_of")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # FILTER_BITS bits in all, whatever the number of chunks.
    return counted.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bits_of")).where(
        F.call_function("getbit", byte, F.pmod(place, F.lit(8))) == 1)


# A term's documents and occurrences in a source, in one part. Larger numbers of
# occurrences come in several cells.
_CELL = np.dtype([("source", "<i8"), ("docs", "<u2"), ("times", "<u2")])


def _after(rest: pa.Table | None, batch: pa.RecordBatch) -> pa.Table:
    table = pa.Table.from_batches([batch])
    return table if rest is None else pa.concat_tables([rest, table]).combine_chunks()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of part and term to documents and occurrences by language and source."""
    directory: tuple = ()
    rest: pa.Table | None = None
    for batch in batches:
        table = _after(rest, batch)
        rest = None
        heads = np.flatnonzero(np.asarray(table.column("term").is_null()))
        ends = [*heads.tolist(), table.num_rows]
        if ends[0] > 0:
            rest = yield from _merged(table.slice(0, ends[0]), directory, len(ends) > 1)
        for begin, end in zip(ends, ends[1:]):
            directory = _directory(table.slice(begin, 1))
            rest = yield from _merged(table.slice(begin + 1, end - begin - 1), directory, end < table.num_rows)
    if rest is not None:
        yield from _merged(rest, directory, True)
    give_back()


def _directory(head: pa.Table) -> tuple:
    """The languages of a part; by document, the number of its source; by that, language and source."""
    groups, group_of = json.loads(head.column("postings")[0].as_py())
    langs = sorted({g[0] for g in groups})
    # In order of the language, so that a term's cells of a language are neighbours.
    order = sorted(range(len(groups)), key=lambda i: groups[i])
    place = np.empty(len(groups), dtype=np.int64)
    place[order] = np.arange(len(groups))
    lang_of = np.array([langs.index(groups[i][0]) for i in order], dtype=np.int64)
    return langs, place[np.array(group_of, dtype=np.int64)], lang_of, np.array([groups[i][1] for i in order], dtype=np.int64)


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers that are not negative."""
    bits = max(1, len(key) - 1).bit_length()
    if not len(key) or int(key.max()) >> (63 - bits):
        return np.argsort(key, kind="stable")
    # Sorting numbers is several times faster than sorting places.
    held = (key.astype(np.int64) << bits) | np.arange(len(key))
    held.sort()
    return held & ((1 << bits) - 1)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    encoded = column.combine_chunks().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return np.asarray(encoded.indices).astype(np.int64), encoded.dictionary


def _merged(rows: pa.Table, directory: tuple, whole: bool):
    """Emit the terms of some rows of one part; give back those of the last term, unless whole."""
    if not rows.num_rows:
        return None
    term, names = _numbered(rows.column("term"))
    rest = None
    if not whole:
        # Rows are in order of the term, so those of the last one are at the end.
        first = int(np.flatnonzero(term == term[-1])[0])
        rest = rows.slice(first)
        if not first:
            return rest
        rows, term = rows.slice(0, first), term[:first]
    langs, group_of, lang_of, source_of = directory
    doc, times, sizes = _expanded(rows.column("postings"))
    # Documents are given by differences, beginning anew with each row.
    doc = np.cumsum(doc)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    doc -= np.repeat(np.where(before > 0, doc[before - 1], 0), sizes)
    m = np.asarray(rows.column("m").combine_chunks()).astype(np.int64)
    n = times * np.repeat(m, sizes)
    # A document holds a term once, in however many chunks.
    key = (np.repeat(term, sizes) << 16) | doc
    order = _order(key)
    key, n = key[order], n[order]
    new = _runs(key)
    key, n = key[new], np.add.reduceat(n, new)
    which = (key >> 16) * len(group_of) + group_of[key & 0xFFFF]
    order = _order(which)
    which, n = which[order], n[order]
    new = _runs(which)
    docs, n, which = np.diff(np.concatenate([new, [len(which)]])), np.add.reduceat(n, new), which[new]
    at, steps = _in_steps(n, 65535)
    cells = np.zeros(len(at), dtype=_CELL)
    term, group = which[at] // len(group_of), which[at] % len(group_of)
    cells["source"], cells["times"] = source_of[group], steps
    cells["docs"] = np.where(np.concatenate([[True], at[1:] != at[:-1]]), docs[at], 0)
    row = term * len(langs) + lang_of[group]
    new = _runs(row)
    yield pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()).take(pa.array(row[new] % len(langs))),
         names.take(pa.array(row[new] // len(langs))),
         _packed(cells, np.concatenate([new, [len(cells)]]), _CELL.itemsize)],
        names=["lang", "term", "cells"])
    return rest


def _added(rows: pa.Table, least_docs: int, whole: bool):
    """Add up cells, rows being in order of language and term; give back the last term's, unless whole."""
    lang, langs = _numbered(rows.column("lang"))
    term, names = _numbered(rows.column("term"))
    key = lang * max(1, len(names)) + term
    rest = None
    if not whole:
        first = int(np.flatnonzero(key == key[-1])[0])
        rest = rows.slice(first)
        if not first:
            return rest
        rows, key = rows.slice(0, first), key[:first]
    new = _runs(key)
    row = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(key)]])))
    key = key[new]
    cells, sizes = _unpacked(rows.column("cells"), _CELL)
    row = np.repeat(row, sizes)
    order = np.lexsort((cells["source"], row))
    row, cells = row[order], cells[order]
    new = np.flatnonzero(np.concatenate(
        [[True], (row[1:] != row[:-1]) | (cells["source"][1:] != cells["source"][:-1])]))
    docs = np.bincount(row, cells["docs"], minlength=len(key)).astype(np.int64)
    counts = np.add.reduceat(cells["times"].astype(np.int64), new)
    row, source = row[new], cells["source"][new]
    stay = docs[row] >= least_docs
    row, source, counts = row[stay], source[stay], counts[stay]
    kept = np.flatnonzero(docs >= least_docs)
    if len(kept):
        ends = np.concatenate([_runs(row), [len(row)]])
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(key[kept] // len(names))), names.take(pa.array(key[kept] % len(names))),
             pa.array(docs[kept], pa.int64()), pa.array(np.add.reduceat(counts, ends[:-1]), pa.int64()),
             _packed(source, ends, 8), _packed(counts, ends, 8)],
            names=["lang", "term", "docs", "times", "sources", "counts"])
    return rest


def _unpacked(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after the other, and how many each row has."""
    array = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    width = np.dtype(kind).itemsize
    held = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // width


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exactly."""
    most = total + 2 * size
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    exact = F.call_function("div", wide, most.cast("decimal(20,0)"))
    # Decimals are slow, and hardly any count needs them.
    small = F.call_function("div", F.lit(SCALE).cast("long") * (count + 2), most)
    return (F.lit(1) + F.when(count + 2 <= F.lit((1 << 62) // SCALE), small).otherwise(exact)).cast("long")


def shares(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """The same for arrays; counts that times SCALE are beyond a long go through whole numbers of any size."""
    if len(counts) and int(counts.max()) + 2 > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (c + 2) // (t + 2 * size) for c, t in zip(counts.tolist(), totals.tolist())],
                        dtype=np.int64)
    return 1 + SCALE * (counts + 2) // (totals + 2 * size)


def by_source(kept: DataFrame) -> DataFrame:
    """(lang, term, times, sid, count): a row for each source that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            source, sizes = _unpacked(table.column("sources"), np.int64)
            counts, _ = _unpacked(table.column("counts"), np.int64)
            for i in range(0, batch.num_rows, 2000):
                j = min(batch.num_rows, i + 2000)
                begin, end = int(sizes[:i].sum()), int(sizes[:j].sum())
                at = pa.array(np.repeat(np.arange(i, j), sizes[i:j]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in ("lang", "term", "times")],
                     pa.array(source[begin:end]), pa.array(counts[begin:end])],
                    names=["lang", "term", "times", "sid", "count"])

    return kept.select("lang", "term", "times", "sources", "counts").mapInArrow(
        run, "lang string, term string, times long, sid long, count long")


def divergence(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
               text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: each other source of the language by how far its shares are from
    this source's, over all kept terms. Part `term`: the `top` kept terms that the
    source has more of than its language.
    """
    empty = F.lit("")
    named = documents.select(*[
        F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    names = materialise(named.select("lang", "source").distinct(), "sources")
    for seed in range(8):
        number = F.xxhash64(F.lit(seed), "source").alias("sid")
        groups = names.select("lang", "source", number)
        if not groups.groupBy("lang", "sid").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("no hash tells all sources apart")
    kept = materialise(term_counts(named.select("text", "lang", number), least_docs), "kept-terms")
    cells = by_source(kept)
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("times").alias("lang_total"))
    of_group = cells.groupBy("lang", "sid").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    totals = materialise(
        groups.join(of_group, ["lang", "sid"], "left").join(of_lang, "lang", "left").select(
            "lang", "source", "sid", F.coalesce("total", zero).alias("total"),
            F.coalesce("size", zero).alias("size"), F.coalesce("lang_total", zero).alias("lang_total")),
        "source-totals")

    p, q = F.col("p"), F.col("q")
    far = F.call_function("div", (p - q) * (p - q), p + q)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.join(totals, ["lang", "sid"]).select(
        "lang", "source", F.col("term").alias("item"),
        _share(F.col("count"), F.col("total"), F.col("size")).alias("p"),
        _share(F.col("times"), F.col("lang_total"), F.col("size")).alias("q"),
    ).where(p > q).select("lang", "source", F.lit("term").alias("part"), "item", far.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = pair_values(kept, totals).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return terms.unionByName(pairs.withColumn("rank", F.row_number().over(best)))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two different sources of a language, both ways."""
    cells = F.max("size") * F.count("*")
    buckets = materialise(totals.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(cells / F.lit(BLOCK))).cast("int").alias("n")), "term-buckets")
    each = totals.join(buckets, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"), "source", "sid", "total", "size")
    dealt = kept.join(buckets, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("n")).cast("int").alias("bucket"), "sources", "counts")

    def block(said: pa.Table, all_: pa.Table) -> pa.Table:
        all_ = all_.sort_by("source")
        names, sid = all_.column("source").to_pylist(), all_.column("sid").to_numpy()
        total, size = all_.column("total").to_numpy(), all_.column("size")[0].as_py()
        held = np.zeros((said.num_rows, len(names)), dtype=np.int64)
        if said.num_rows:
            source, sizes = _unpacked(said.column("sources"), np.int64)
            order = np.argsort(sid)
            place = order[np.searchsorted(sid[order], source)]
            held[np.repeat(np.arange(len(sizes)), sizes), place] = _unpacked(said.column("counts"), np.int64)[0]
            p = shares(held.ravel(), np.tile(total, len(held)), size).reshape(held.shape)
        else:
            p = held
        a, b, value = [], [], []
        for i in range(len(names) - 1):
            mine, theirs = p[:, i : i + 1], p[:, i + 1 :]
            value += ((mine - theirs) ** 2 // (mine + theirs)).sum(axis=0).tolist()
            a += [names[i]] * (len(names) - 1 - i)
            b += names[i + 1 :]
        lang = all_.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()),
                         "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    halves = dealt.groupBy("lang", "bucket").cogroup(each.groupBy("lang", "bucket")).applyInArrow(
        block, "lang string, a string, b string, value long")
    halves = halves.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # The distance is the same both ways.
    return halves.select("lang", "value", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
