"""Language identification by a bit-sliced Bloom filter of n-grams.

The filter has one row per position and one bit per language: a language's n-grams
set its bit in `PROBES` rows each. Looking an n-gram up takes the AND of its rows,
which is a mask of *all* languages that hold it, for the price of one lookup. A
text's masks are counted per language, each count is corrected for the share of
n-grams that the language's column would let through by chance,

    (hits - n * chance) / (1 - chance),  chance = (filled rows / rows) ** PROBES,

and the language with the largest corrected count decides (ties: the first in
order of the learned values). The score is that count over the number of n-grams.

N-grams are runs of `SIZES` characters of the lower-cased text, in which everything
but letters is one space, with a space at both ends. A language holds the n-grams
that are about as frequent in it as where they are most frequent (`LEAST_SHARE`),
so what all languages share counts for all, and a stray foreign word for none.

Learning takes at most `MAX_ROWS` labelled rows of each language (of the `MAX_LANGUAGES`
that have most rows, ties by value), chosen by a hash of doc_id, whole texts; their n-grams are counted in tasks, and at most `MAX_GRAMS`
of each language come to the driver. All else covers every row and every text whole.

A null text, or one without a letter, is `und` with score 0, and so is every text if
nothing was learned; a text none of whose n-grams is known gets the learned language
of most rows, with score 0. Rows without a doc_id are judged, not learned from. A
text of more than `PIECE` characters is read in pieces that end with a word (or at
that length within a longer one), and no n-gram spans two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, slices, with_columns_from

SIZES = (3, 4)
PROBES = 2
MAX_ROWS = 2000
MAX_GRAMS = 1 << 15
MAX_LANGUAGES = 256
LEAST_COUNT = 3
LEAST_SHARE = 0.25
# Rows of the filter for each n-gram of the language that has most.
ROWS_PER_GRAM = 16
PIECE = 1 << 20
UNKNOWN = "und"
_SPACE = 32


@cache
def _is_letter() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def pieces(text: str) -> Iterator[str]:
    """The text, or its pieces of at most PIECE characters."""
    begin = 0
    while len(text) - begin > PIECE:
        end = begin + PIECE
        cut = next((i for i in range(end - 1, begin, -1) if not text[i].isalpha()), end)
        yield text[begin:cut]
        begin = cut
    yield text[begin:] if begin else text


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram of some texts."""
    lows = [p.lower() for t in texts for p in pieces(t or "")]
    of = [i for i, t in enumerate(texts) for _ in pieces(t or "")] if len(lows) > len(texts) else None
    # Two spaces are between two texts, and nowhere within one: an n-gram that
    # holds them belongs to no text.
    points = np.frombuffer("".join(f"\n{t}\n" for t in lows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(lows), dtype=np.int32), [len(t) + 2 for t in lows])
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= points == 10
    # A line break within a text counts only as the space that ends a word.
    inner = np.ones(len(points), dtype=bool)
    ends = np.cumsum([len(t) + 2 for t in lows])
    inner[ends - 1] = False
    inner[ends[:-1]] = False
    inner[:1] = False
    again = inner & (points == 10)
    again[1:] &= ~letter[:-1]
    keep &= ~again
    points = np.where(letter, points, np.uint32(_SPACE))[keep].astype(np.uint64)
    owner = owner[keep]
    blank = points == _SPACE
    both = blank[:-1] & blank[1:]
    found, owners = [], []
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        ok = ~both[:n].copy()
        for i in range(1, size - 1):
            ok &= ~both[i : i + n]
        at = np.flatnonzero(ok)
        key = points[at] | points[at + 1] << np.uint64(21) | points[at + 2] << np.uint64(42)
        for i in range(3, size):
            key = _mixed(key) + points[at + i]
        found.append(_mixed(key ^ np.uint64(size)))
        owners.append(owner[at])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    owners_ = np.concatenate(owners)
    return (owners_ if of is None else np.array(of)[owners_]), np.concatenate(found)


@dataclass(frozen=True)
class LanguageFilter:
    """Rows of language bits, and what each language's column passes by chance."""

    languages: tuple[str, ...]
    rows: np.ndarray  # (words, rows): a bit for each language, 64 in a word
    chance: np.ndarray
    usual: int  # the language of most rows

    @staticmethod
    def build(known: dict[str, np.ndarray], usual: str) -> LanguageFilter:
        languages = tuple(sorted(known))
        most = max([1, *(len(g) for g in known.values())])
        size = 1 << int(np.ceil(np.log2(most * ROWS_PER_GRAM)))
        kind = np.uint8 if len(languages) <= 8 else np.uint32 if len(languages) <= 32 else np.uint64
        width = np.dtype(kind).itemsize * 8
        rows = np.zeros((-(-len(languages) // width), size), dtype=kind)
        filled = np.zeros(len(languages))
        for i, language in enumerate(languages):
            for probe in _probes(known[language], size):
                rows[i // width, probe] |= kind(1 << (i % width))
            filled[i] = ((rows[i // width] >> kind(i % width)) & kind(1)).mean()
        return LanguageFilter(languages, rows, filled**PROBES, languages.index(usual))

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(words, n): all languages that hold each n-gram, as bits."""
        found = None
        for probe in _probes(hashes, self.rows.shape[1]):
            taken = self.rows[:, probe]
            found = taken if found is None else found & taken
        return found

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected count by text and language, n-grams by text)."""
        owner, hashes = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        kind = self.rows.dtype.type
        width = self.rows.dtype.itemsize * 8
        masks = self.masks(hashes)
        for i in range(len(self.languages)):
            held = owner[(masks[i // width] & kind(1 << (i % width))) != 0]
            hits[:, i] = np.bincount(held, minlength=len(texts))
        return (hits - n[:, None] * self.chance) / (1 - self.chance), n

    def decide(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        corrected, n = self.counts(texts)
        best = corrected.argmax(axis=1)
        top = corrected[np.arange(len(texts)), best]
        best = np.where(top > 0, best, self.usual)
        score = np.clip(top / np.maximum(n, 1), 0.0, 1.0)
        # Every n-gram has a letter, and every letter is in one.
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())], score


def _probes(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    bits = np.uint64(64 // PROBES)
    for i in range(PROBES):
        yield ((hashes >> (np.uint64(i) * bits)) & np.uint64(size - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(documents: DataFrame, max_rows: int = MAX_ROWS, text: str = "text") -> DataFrame:
    """(lang, text, rows): at most `max_rows` rows of each language; `rows` of all it has."""
    spark = documents.sparkSession
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    rows = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES)
    # A row for each language, of which there are MAX_LANGUAGES at most.
    rows = F.broadcast(spark.createDataFrame(rows.collect(), "lang string, rows long"))
    # A hash lets through about twice the rows that are asked for, so that few
    # texts travel; a doc_id that very many rows share is cut by the limit below.
    some = known.join(rows, "lang").where(
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) * F.col("rows").cast("double")
        < F.lit(float(2 * max_rows + 100) * (1 << 30)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id", "text")
    return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_rows).select(
        "lang", "text", "rows")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, rows, gram, n): how often the texts of each language hold an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            names = batch.column("lang").to_pylist()
            rows = dict(zip(names, batch.column("rows").to_pylist()))
            owner, hashes = grams(batch.column("text").to_pylist())
            numbers = {name: i for i, name in enumerate(rows)}
            lang = np.array([numbers[name] for name in names])[owner]
            for name, i in numbers.items():
                found, n = np.unique(hashes[lang == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()),
                     pa.array(np.full(len(found), rows[name], dtype=np.int64)),
                     pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "rows", "gram", "n"])
        give_back()

    found = texts.mapInArrow(run, "lang string, rows long, gram long, n long")
    return found.groupBy("lang", "rows", "gram").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS, text: str = "text"
        ) -> LanguageFilter | None:
    """The filter of all languages that the rows which are not held out name."""
    counted = gram_counts(sample(documents, max_rows, text))
    of_lang, of_gram = Window.partitionBy("lang"), Window.partitionBy("gram")
    # The sample is bounded, and with it what meets in a window.
    rate = counted.withColumn("rate", F.col("n") / F.sum("n").over(of_lang))
    held = rate.withColumn("most", F.max("rate").over(of_gram)).where(
        (F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_SHARE * F.col("most")))
    held = held.withColumn("_r", F.row_number().over(of_lang.orderBy(F.desc("n"), "gram"))).where(
        F.col("_r") <= max_grams)
    found = held.select("lang", "rows", "gram").toArrow()
    known: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    lang = found.column("lang").combine_chunks()
    gram = found.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    for name in sorted(set(lang.to_pylist())):
        at = np.asarray(pa.compute.equal(lang, name))
        known[name] = gram[at]
        rows[name] = found.column("rows").to_numpy()[at][0]
    if not known:
        return None
    return LanguageFilter.build(known, max(sorted(rows), key=lambda name: rows[name]))


def identify(documents: DataFrame, max_rows: int = MAX_ROWS, text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    filter_ = fit(documents, max_rows, text=text)
    rows = documents.select("doc_id", F.col(text).cast("string").alias("_text"))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if filter_ is None:
        return rows.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = documents.sparkSession.sparkContext.broadcast(filter_)

    def make():
        decide = sent.value.decide

        def work(column: pa.Array) -> list[pa.Array]:
            names, score = decide(column.to_pylist())
            return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    judged = with_columns_from(rows, "_text", fields, make, batch_bytes=1 << 20)
    return judged.select("doc_id", held, "lang_pred", "score")
