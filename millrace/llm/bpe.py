"""Byte-level BPE encoding and decoding by a table of distinct words.

A *word* here is what lies between two positions where a single space follows a
visible character and precedes one: the tokenizer's own splitting never crosses
such a place, so the ids of a text are the ids of its words in order.

1. Words are split and counted in Spark; the distinct words meet in one table.
2. The frequent words (at most `head_words`, chosen by a power of two of their
   count) are encoded once each, and their ids go to all tasks: a broadcast of
   bounded size.
3. Ids are joined back by position: each text is split again and its words are
   looked up. Words below the threshold are put in a distinct-word table of the
   task they occur in and encoded there once, so that no position is shuffled.
4. Decoding looks each id up in the table of pieces (of the size of the vocabulary)
   and reads their bytes as UTF-8.

Null texts count as empty and have no ids. Words of texts with other white space are
looked up in the same tables; what holds white space besides the space before it, and a
text that holds the spelling of a special token, is encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, slices, with_columns_from

HEAD_WORDS = 1 << 17
CACHE_WORDS = 60_000
# Text encoded at once; its words, positions, ids and digests take many times that.
ENCODE_BYTES = 1 << 20
LONGEST_CACHED = 64

_SPLIT = re.compile(r"(?<=\S)(?= \S)").split
# Visible characters only, but for one space that may come first.
_LINE = re.compile(r" ?\S+").fullmatch
# Fixed value: the special token of the byte-level vocabulary.
_SPECIALS = ["<|endoftext|>"]
# Texts with a special token's spelling or with white space other than line ends
# and single spaces between visible characters.
_ODD = (
    r"^[ \n]|[ \n]$|[ \n][ \n]|<\|endoftext\|>|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Where a word ends in a Latin letter and ASCII marks, the tokenizer cuts.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER_AT_END = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]$"


def default_tokenizer() -> str:
    """The public 50k byte-level vocabulary, by its installed path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(words: pa.Array) -> tuple[pa.DictionaryArray, list[str], np.ndarray]:
    """Words as cores and the (up to eight) marks that close them.

    Returns the cores, the distinct closing marks, and which of them each word has.
    """
    core = pa.compute.utf8_rtrim(words, characters=_MARKS)
    n = np.asarray(pa.compute.subtract(
        pa.compute.binary_length(words), pa.compute.binary_length(core))).astype(np.int64)
    cut = (n > 0) & (n <= 8) & np.asarray(pa.compute.match_substring_regex(core, _LETTER_AT_END))
    core = pa.compute.if_else(pa.array(cut), core, words)
    n = np.where(cut, n, 0)
    # The marks as one number: the last byte lowest, nothing above the first.
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[
        words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", dtype=np.uint8)
    marks = np.zeros(len(words), dtype=np.uint64)
    for i in range(int(n.max(initial=0))):
        has = n > i
        marks[has] |= data[ends[has] - 1 - i].astype(np.uint64) << np.uint64(8 * i)
    distinct, which = np.unique(marks, return_inverse=True)
    names = [int(m).to_bytes(8, "big").lstrip(b"\0").decode() for m in distinct]
    return core.dictionary_encode(), names, which


def _lines_and_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts that are not odd: where texts begin among the lines, lines among the words."""
    lines = pa.compute.split_pattern(texts, "\n")
    words = pa.compute.split_pattern(lines.flatten(), " ")
    return (np.asarray(lines.offsets).astype(np.int64), np.asarray(words.offsets).astype(np.int64),
            words.flatten())


class _Recent:
    """A map of bounded size: a fixed part, and the two latest generations."""

    def __init__(self, limit: int, fixed: dict[str, bytes] | None = None) -> None:
        self._limit = limit
        self._fixed = fixed
        self._map: dict[str, bytes] = {}
        self._young: list[str] = []
        self._old: list[str] = []
        self.get = self._of_either if fixed else self._map.get

    def _of_either(self, word: str) -> bytes | None:
        found = self._fixed.get(word)
        return self._map.get(word) if found is None else found

    def add(self, new: dict[str, bytes]) -> None:
        """Entries that are not there yet."""
        self._map.update(new)
        self._young += new
        if len(self._young) >= self._limit:
            for k in self._old:
                del self._map[k]
            self._old, self._young = self._young, []


class WordCodec:
    """Encodes words once each, within a bounded memory.

    Ids are kept as little-endian unsigned 32-bit integers.
    """

    def __init__(self, tokenizer: str, head: dict[str, bytes] | None = None,
                 cache_words: int = CACHE_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if any(s not in _SPECIALS for s in self._special):
            raise ValueError(f"special tokens other than {_SPECIALS}: {self._special}")
        self._words = _Recent(cache_words, head)
        self._alone = _Recent(cache_words)
        self._newline = self._library(["\n"])[0]
        self._newline_id = int(np.frombuffer(self._newline, dtype="<u4")[0])

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _library_words(self, words: list[str], plain: bool = False) -> list[bytes]:
        """Ids of many short words, a few hundred lines of one word in each call.

        `plain` says that no word holds white space (but a space before it) or
        a special token.
        """
        every = words
        if not plain:
            words = [w for w in words if _LINE(w) and not any(s in w for s in self._special)]
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        lines = self._tokenizer.encode_batch_fast(["\n".join(g) for g in groups],
                                                  add_special_tokens=False)
        cut = []
        for group, line in zip(groups, lines):
            ids = np.array(line.ids, dtype="<u4")
            packed = ids.tobytes()
            ends = [*(4 * np.flatnonzero(ids == self._newline_id)).tolist(), len(packed)]
            if len(ends) != len(group):
                raise ValueError("a word holds a line end")
            cut += [packed[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]
        if plain:
            return cut
        found = dict(zip(words, cut))
        other = [w for w in every if w not in found]
        found.update(zip(other, self._library(other)))
        return [found[w] for w in every]

    def _look_up(self, cache: _Recent, words: list[str], before: str) -> list[bytes]:
        """Ids of distinct words, with `before` put before each."""
        out = list(map(cache.get, words))
        missing = [w for w, ids in zip(words, out) if ids is None and w]
        learnt = dict(zip(missing, self._library_words([before + w for w in missing], True)))
        cache.add({w: ids for w, ids in learnt.items() if len(w) <= LONGEST_CACHED})
        learnt[""] = b""
        return [learnt[w] if ids is None else ids for w, ids in zip(words, out)]

    def encode_alone(self, words: list[str]) -> list[bytes]:
        """Packed ids of single words, each encoded as it is."""
        return self._library(words)

    def encode(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text, as a binary array."""
        texts = texts.fill_null("")
        odd = np.asarray(pa.compute.match_substring_regex(texts, _ODD))
        flat, ends = self._encode_even(texts.filter(pa.array(~odd)) if odd.any() else texts)
        if not odd.any():
            return _binary(flat, ends)
        apart = {int(i): self._encode_odd(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        evens = iter(np.split(flat, ends[1:-1])) if len(ends) > 1 else iter([])
        each = [apart[i] if i in apart else next(evens) for i in range(len(texts))]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return _binary(np.concatenate(each), ends)

    def _encode_odd(self, text: str) -> np.ndarray:
        """A text with special tokens or white space other than single spaces."""
        if any(s in text for s in self._special):
            return np.frombuffer(self._library([text])[0], dtype="<u4")
        units = _SPLIT(text)
        distinct = list(dict.fromkeys(units))
        words = [u for u in distinct if u[:1] == " " and _LINE(u)]
        known = set(words)
        other = [u for u in distinct if u not in known]
        ids = dict(zip(words, self._look_up(self._words, [w[1:] for w in words], " ")))
        ids.update(zip(other, self._library_words(other)))
        return np.frombuffer(b"".join(map(ids.__getitem__, units)), dtype="<u4")

    def _encode_even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins and ends in it."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        text_at, line_at, words = _lines_and_words(texts)
        distinct = words.dictionary_encode()
        which = np.asarray(distinct.indices).astype(np.int64)
        core, marks, closing = _cut(distinct.dictionary)
        cores = self._look_up(self._words, core.dictionary.to_pylist(), " ")
        closes = self._look_up(self._alone, marks, "")
        packed = [
            cores[c] + closes[m] for c, m in zip(core.indices.to_pylist(), closing.tolist())
        ]
        # The first word of a line has no space before it; all but the first
        # line of a text have a line end there.
        heads = words.take(pa.array(line_at[:-1])).dictionary_encode()
        first = np.asarray(heads.indices).astype(np.int64)
        alone = self._look_up(self._alone, heads.dictionary.to_pylist(), "")
        later = np.ones(len(first), dtype=bool)
        later[text_at[:-1]] = False
        which[line_at[:-1]] = len(packed) + first + later * len(alone)
        packed += alone + [self._newline + ids for ids in alone]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        blob = np.frombuffer(b"".join(packed), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        after = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(starts[which] - after[:-1], each)
        source += np.arange(len(source))
        return blob[source], after[line_at[text_at]]


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((ends * 4).astype(np.int32).tobytes())
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(flat).tobytes())]
    )


def piece_table(tokenizer: str) -> list[bytes]:
    """Bytes of each id; special tokens stand for their own spelling."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte-level alphabet: printable characters stand for themselves, the
    # other bytes for the characters from U+0100 on, in order.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def _counted(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, n.cast(pa.int64())], names=["word", "n"])


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct word of all texts with its number of occurrences."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).drop_null()
            odd = pa.compute.match_substring_regex(texts, _ODD)
            units = [u for t in texts.filter(odd).to_pylist() for u in _SPLIT(t)]
            _, line_at, words = _lines_and_words(texts.filter(pa.compute.invert(odd)))
            firsts = words.take(pa.array(line_at[:-1]))
            rest = np.ones(len(words), dtype=bool)
            rest[line_at[:-1]] = False
            met = words.filter(pa.array(rest)).value_counts()
            n = np.asarray(met.field(1))
            core, marks, closing = _cut(met.field(0))
            total = np.bincount(np.asarray(core.indices), n, len(core.dictionary)).astype(np.int64)
            spaced = pa.compute.binary_join_element_wise("", core.dictionary, " ")
            yield _counted(spaced, pa.array(total))
            total = np.bincount(closing, n, len(marks)).astype(np.int64)
            yield _counted(pa.array(marks, pa.string()), pa.array(total))
            alone = pa.concat_arrays([firsts, pa.array(units, pa.string())]).value_counts()
            yield _counted(alone.field(0), alone.field(1))
        give_back()

    rows = documents.select(text).mapInArrow(run, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, limit: int = HEAD_WORDS) -> DataFrame:
    """Words that occur 2^b times or more, b being the least that leaves `limit` words."""
    level = F.floor(F.log2("n")).cast("int")
    by_level = {r[0]: r[1] for r in counts.groupBy(level.alias("b")).count().collect()}
    kept, threshold = 0, max(by_level, default=0) + 1
    for b in sorted(by_level, reverse=True):
        if kept + by_level[b] > limit:
            break
        kept, threshold = kept + by_level[b], b
    short = F.octet_length("word") <= LONGEST_CACHED
    return counts.where((level >= threshold) & short).select("word")


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct-word table: each word with its packed ids."""

    def make():
        codec = WordCodec(tokenizer)
        return lambda column: [pa.array(codec.encode_alone(column.to_pylist()), pa.binary())]

    return with_columns_from(words, "word", [T.StructField("ids", T.BinaryType())], make)


def encode_documents(
    documents: DataFrame,
    tokenizer: str | None = None,
    text: str = "text",
    head_limit: int = HEAD_WORDS,
    ids: str = "ids",
) -> DataFrame:
    """Add the packed ids of each text (little-endian unsigned 32-bit)."""
    tokenizer = tokenizer or default_tokenizer()
    head = _head_table(documents, tokenizer, text, head_limit)

    def make():
        codec = WordCodec(tokenizer, head.value)
        return lambda column: [codec.encode(column)]

    return with_columns_from(
        documents, text, [T.StructField(ids, T.BinaryType())], make, ENCODE_BYTES)


def _head_table(documents: DataFrame, tokenizer: str, text: str, limit: int):
    from millrace.llm.common import materialise

    counts = materialise(count_words(documents, text), "word-counts")
    table = encode_words(head_words(counts, limit), tokenizer).toArrow()
    pairs = zip(table.column("word").to_pylist(), table.column("ids").to_pylist())
    words = {w[1:]: ids for w, ids in pairs if w[:1] == " "}
    return documents.sparkSession.sparkContext.broadcast(words)


def decode_ids(packed: bytes, pieces: list[bytes]) -> str:
    """Text of packed ids: id to piece, pieces to bytes, bytes to UTF-8."""
    ids = np.frombuffer(packed, dtype="<u4").tolist()
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", errors="replace")


REAL_OUTPUTS = [
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
]
DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def encode_and_decode(
    documents: DataFrame,
    tokenizer: str | None = None,
    text: str = "text",
    head_limit: int = HEAD_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """Add the ids of each text, the text decoded from them, and number and digests of the two.

    `ids` are packed (little-endian unsigned 32-bit), `decoded` is read from them alone.
    Without `keep_text` the text itself does not come back from the tasks' Python.
    """
    tokenizer = tokenizer or default_tokenizer()
    head = _head_table(documents, tokenizer, text, head_limit)

    def make():
        codec = WordCodec(tokenizer, head.value)
        pieces = piece_table(tokenizer)
        names = [str(i) for i in range(len(pieces))]

        def work(column: pa.Array) -> list[pa.Array]:
            packed = codec.encode(column)
            n, of_ids, texts, of_text = [], [], [], []
            for ids in packed.to_pylist():
                values = np.frombuffer(ids, dtype="<u4").tolist()
                n.append(len(values))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, values)).encode()).hexdigest())
                decoded = b"".join(map(pieces.__getitem__, values)).decode("utf-8", errors="replace")
                texts.append(decoded)
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            return [packed, pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(of_ids),
                    pa.array(of_text)]

        return work

    return with_columns_from(
        documents, text, REAL_OUTPUTS + DIGESTS, make, ENCODE_BYTES, keep_text)
