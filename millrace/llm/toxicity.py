"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
toxic texts from which everything is taken out that both classes say (what is
left is significantly more frequent in toxic texts). A window of a text is
compressed with the ordinary dictionary and with both; the difference of the two
lengths is what the toxic dictionary explains. Windows are cut at word ends, so
they cover the whole text. How many windows differ by how many bytes, and the
largest differences, are the features of a logistic model, fitted to what
dictionaries say of texts they were not trained on.

The threshold of 0.5 is calibrated twice: to the classes' numbers among all
labelled rows (the sample may have them in another proportion), and so that of
the ordinary texts of the folds left out at least `CLEAN` stay below it.

Training takes at most `max_rows` labelled rows of each class with at most
`max_row_bytes` bytes of text each, chosen by a hash of doc_id; near copies among
them count once. All else covers every row and every text whole. A null text counts
as empty; a text without words gets the score of a text whose windows do not differ
at all.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence, Set
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import give_back, materialise, slices, with_columns_from

MAX_ROWS = 3000
MAX_ROW_BYTES = 1 << 16
WINDOW_BYTES = 96
TOXIC_BYTES = 4096
ORDINARY_BYTES = 24 << 10
# Any fixed bytes that texts do not hold.
BALLAST = bytes(range(1, 9)) * 2 + bytes(range(14, 32))
# The shortest match of the compressor.
MIN_MATCH = 5
# A window's difference counts from each of these numbers of bytes on.
STEPS = (1, 2, 3, 4, 5, 6, 8)
# What enters the toxic dictionary is in so many toxic texts, and so much more frequent
# there (likelihood ratio, in nats beyond what the best of all candidates has by chance).
LEAST_TEXTS = 3
LEAST_NATS = 3.0
# The share of ordinary texts that stay below the threshold, at least.
CLEAN = 0.98
# Of ordinary windows, what the trainer is given at most.
TRAINER_BYTES = 12 << 20
# Texts that share so many of their SKETCH least shingle hashes are near copies.
SKETCH = 8
SKETCH_SHARED = 4
# Parts of the training rows, each scored by dictionaries of the others.
FOLDS = 4
# What Spark's logarithms may differ by from numpy's.
ROUNDING_NATS = 1e-6


@dataclass(frozen=True)
class ToxicityModel:
    """What a task needs: two dictionaries and the weights of the features."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    shift: tuple[float, ...]
    scale: tuple[float, ...]
    window_bytes: int = WINDOW_BYTES

    def scorer(self):
        lengths = WindowLengths(self.ordinary, self.toxic, self.window_bytes)
        weights, shift, scale = map(np.array, (self.weights, self.shift, self.scale))

        def score(texts: Sequence[str | None]) -> np.ndarray:
            x = np.array([features(lengths.differences(t)) for t in texts]).reshape(len(texts), -1)
            z = ((x - shift) / scale) @ weights[1:] + weights[0]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """The text in windows of about `size` bytes that begin and end with words.

    White space between words becomes one space; A-Z are lower-cased. A longer
    word is cut, with half a window of overlap.
    """
    words = (text or "").encode().lower().split()
    if words and max(map(len, words)) > size:
        words = [
            w[i : i + size] for w in words
            for i in range(0, max(1, len(w) - size // 2), size // 2)
        ]
    out, begin, held = [], 0, 0
    for i, n in enumerate(map(len, words)):
        if held and held + n > size:
            out.append(b" " + b" ".join(words[begin:i]) + b" ")
            begin, held = i, 0
        held += n + 1
    if begin < len(words):
        out.append(b" " + b" ".join(words[begin:]) + b" ")
    return out


class WindowLengths:
    """Compressed lengths of windows with and without the toxic dictionary.

    Both dictionaries end with the same ordinary content, so a window that the
    toxic part says nothing about has the same length with either. Literals are
    left as they are, and every window has `BALLAST` before it, which both
    dictionaries know: it keeps the compressor from storing a window raw, where
    a few bytes less would not show.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, window_bytes: int = WINDOW_BYTES) -> None:
        self._size = window_bytes
        self._plain = self._compressor(ordinary + BALLAST)
        # The compressor indexes every third byte first: a multiple of three bytes
        # before it leaves the index of the ordinary content as it is.
        self._both = self._compressor(toxic + b"\n" * (-len(toxic) % 24) + ordinary + BALLAST)

    @staticmethod
    def _compressor(content: bytes):
        # The same tables for both dictionaries, whatever their sizes. The fast
        # strategy with a target length does not compress literals.
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=16, search_log=1, min_match=MIN_MATCH,
            target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False,
            write_checksum=False, write_dict_id=False)
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress

    def differences(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves, per window."""
        parts = [BALLAST + w for w in windows(text, self._size)]
        n = len(parts)
        plain = np.fromiter(map(len, map(self._plain, parts)), dtype=np.int32, count=n)
        return plain - np.fromiter(map(len, map(self._both, parts)), dtype=np.int32, count=n)


def features(differences: np.ndarray) -> list[float]:
    n = max(1, len(differences))
    top = np.sort(differences)[::-1][:3] if len(differences) else np.zeros(0)
    top = np.concatenate([top, np.zeros(3 - len(top))])
    counts = [int((differences >= s).sum()) for s in STEPS]
    return [
        *top.tolist(),
        *[min(c, 3) for c in counts],
        *[c / n for c in counts],
        float(np.log1p(n)),
    ]


# A part's numbers of texts: toxic ones by fold, then ordinary ones by fold.
Counts = Mapping[bytes, Sequence[int]]


def count_parts(texts: Iterable[tuple[str, int]]) -> dict[bytes, list[int]]:
    """In how many texts (text, label) of each label and fold each part occurs."""
    counts: dict[bytes, list[int]] = {}
    for text, label in texts:
        place = _fold(text) + (0 if label else FOLDS)
        for part in _parts(text):
            if part not in counts:
                counts[part] = [0] * (2 * FOLDS)
            counts[part][place] += 1
    return counts


def telling_parts(counts: Counts, toxic: Sequence[str], ordinary: Sequence[str], without: int | None = None,
                  candidates: int | None = None) -> set[bytes]:
    """Parts that tell, by all texts but those of a fold.

    Those whose numbers of toxic and ordinary texts are further from the classes'
    proportion, toward the toxic side, than the most extreme of so many would be by
    chance. What all texts have in common tells nothing; an ordinary text that
    quotes a toxic word, or is labelled wrong, bars nothing. `candidates` says how many
    parts are in enough toxic texts, if `counts` has only some of them.
    """
    folds = [f for f in range(FOLDS) if f != without]
    rate = _toxic_rate(toxic, ordinary, without)
    with_ = {}
    for part, n in counts.items():
        both = sum(n[f] for f in folds), sum(n[FOLDS + f] for f in folds)
        if both[0] >= LEAST_TEXTS:
            with_[part] = both
    least = _least_nats(len(with_) if candidates is None else candidates)
    return {part for part, both in with_.items() if _nats(*both, rate) >= least}


def _toxic_rate(toxic: Sequence[str], ordinary: Sequence[str], without: int | None) -> float:
    """The share of toxic texts among all but those of a fold."""
    sizes = [sum(_fold(t) != without for t in texts) for texts in (toxic, ordinary)]
    return sizes[0] / max(1, sum(sizes))


def _least_nats(candidates: int) -> float:
    return LEAST_NATS + np.log(max(1, candidates))


def train_dictionaries(toxic: Sequence[str], ordinary: Sequence[str], telling: Set[bytes] | None = None
                       ) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents, both trained by zstandard.

    Toxic texts are cut down to the whole words and stretches of MIN_MATCH bytes
    that tell; what all texts have in common would only teach the dictionary
    ordinary text again.
    """
    if telling is None:
        counts = count_parts([*[(t, 1) for t in toxic], *[(t, 0) for t in ordinary]])
        telling = telling_parts(counts, toxic, ordinary)
    samples, count = [], Counter()
    for text in toxic:
        runs = sorted({r for w in _words(text) for r in _runs(w, telling)})
        if runs:
            samples.append(b"\n".join(runs) + b"\n")
            count.update(runs)
    beyond = _trained(samples, TOXIC_BYTES) if samples else b"\n"
    # The trainer leaves out what is rare; where there is room it goes before the rest.
    room = TOXIC_BYTES - len(beyond)
    for run, _ in sorted(count.items(), key=lambda c: (-c[1], c[0])):
        if len(run) < room and run not in beyond:
            beyond = run + b"\n" + beyond
            room -= len(run) + 1
    plain: list[bytes] = []
    for text in ordinary:
        plain += windows(text)
        if len(plain) * WINDOW_BYTES > TRAINER_BYTES:
            break
    return _trained(plain, ORDINARY_BYTES), beyond


def _nats(toxic: int, ordinary: int, rate: float) -> float:
    """Log likelihood ratio of the share of toxic texts against `rate`; 0 if it is not above."""
    n = toxic + ordinary
    if toxic <= rate * n or not 0 < rate < 1:
        return 0.0
    found = toxic * np.log(toxic / (rate * n))
    return float(found + (ordinary * np.log(ordinary / ((1 - rate) * n)) if ordinary else 0.0))


def without_near_copies(texts: Sequence[str]) -> list[str]:
    """The texts, of near copies the first: those that share most of their least shingle hashes."""
    kept: list[str] = []
    seen: dict[int, list[int]] = defaultdict(list)
    for text in texts:
        words = (text or "").encode().lower().split()
        shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        sketch = sorted(xxhash.xxh3_64_intdigest(s) for s in shingles)[:SKETCH]
        shared = Counter(k for h in sketch for k in seen[h])
        if not shared or max(shared.values()) < min(SKETCH_SHARED, len(sketch)):
            for h in sketch:
                seen[h].append(len(kept))
            kept.append(text)
    return kept


def _parts(text: str | None) -> set[bytes]:
    """Stretches of a text's words, and the words that are not too long."""
    words = _words(text)
    return {g for w in words for g in _stretches(w)} | {
        w for w in words if MIN_MATCH < len(w) <= WINDOW_BYTES // 2}


def _stretches(run: bytes) -> set[bytes]:
    return {run[i : i + MIN_MATCH] for i in range(len(run) - MIN_MATCH + 1)}


def _words(text: str | None) -> set[bytes]:
    return {b" " + w + b" " for w in (text or "").encode().lower().split()}


def _runs(word: bytes, telling: Set[bytes]) -> list[bytes]:
    """The word if it tells by itself, else its longest parts all of whose stretches do."""
    if word in telling:
        return [word]
    out, begin = [], None
    for i in range(len(word) - MIN_MATCH + 1):
        if word[i : i + MIN_MATCH] not in telling:
            begin = None
        elif begin is None:
            begin = i
            out.append(word[i : i + MIN_MATCH])
        else:
            out[-1] = word[begin : i + MIN_MATCH]
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"        "


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps; x has no constant column."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty,
                               x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: Sequence[str], ordinary: Sequence[str], odds: float | None = None,
          telling: Mapping[int | None, Set[bytes]] | None = None) -> ToxicityModel:
    """Dictionaries from all texts; the model from texts each left out of a fold's dictionaries.

    `odds` is how many toxic texts come on an ordinary one outside the sample. `telling`
    are the `telling_parts` of these texts without each fold, and of all (None); near
    copies were left out of them then.
    """
    if telling is None:
        toxic, ordinary = without_near_copies(toxic), without_near_copies(ordinary)
        counts = count_parts([*[(t, 1) for t in toxic], *[(t, 0) for t in ordinary]])
        telling = {f: telling_parts(counts, toxic, ordinary, without=f) for f in (*range(FOLDS), None)}
    rows, held = [], []
    for fold in range(FOLDS):
        rest = [[t for t in texts if _fold(t) != fold] for texts in (toxic, ordinary)]
        out = [(t, y) for y, texts in ((1, toxic), (0, ordinary)) for t in texts if _fold(t) == fold]
        if out:
            lengths = WindowLengths(*train_dictionaries(*rest, telling[fold]))
            rows += [features(lengths.differences(t)) for t, _ in out]
            held += out
    content, beyond = train_dictionaries(toxic, ordinary, telling[None])
    if not held:
        held = [("", 0)]
        rows = [features(np.zeros(0, dtype=np.int32))]
    x = np.array(rows, dtype=float)
    y = np.array([label for _, label in held], dtype=float)
    shift, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        weights = np.zeros(x.shape[1] + 1)
        weights[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    else:
        weights = fit_logistic((x - shift) / scale, y)
        weights[0] += np.log((odds or y.sum() / (len(y) - y.sum())) * (len(y) - y.sum()) / y.sum())
        z = ((x - shift) / scale) @ weights[1:] + weights[0]
        # A value that many ordinary texts have in common stays below, too.
        top = np.sort(z[y == 0])[min(int(np.ceil(CLEAN * (y == 0).sum())), int((y == 0).sum()) - 1)]
        weights[0] -= max(0.0, top + 1e-6)
    return ToxicityModel(content, beyond, tuple(weights), tuple(shift), tuple(scale))


def _fold(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text or "") % FOLDS


def held_out(doc_id) -> F.Column:
    """Rows that are never trained on: crc32 of the id as text is a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
        max_row_bytes: int = MAX_ROW_BYTES, text: str = "text") -> ToxicityModel:
    """Train on a bounded sample of labelled rows that are not held out."""
    rows = documents.select(F.col("doc_id").alias("_id"), F.col(text).alias("_text"))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where(
        F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id")))
    numbers = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    odds = numbers[1] / numbers[0] if len(numbers) == 2 else None
    order = [F.xxhash64("_id"), F.col("_id")]
    parts = []
    for label in (1, 0):
        some = known.where(F.col("_toxic") == label).select("_id").distinct().orderBy(*order).limit(max_rows)
        # The sampled ids are bounded in number, so they may be broadcast.
        found = rows.where(F.octet_length("_text") <= max_row_bytes).join(
            F.broadcast(some), "_id", "left_semi")
        taken = found.orderBy(*order, "_text").limit(max_rows)
        parts.append(taken.select("_id", "_text", F.lit(label).alias("_toxic")))
    # The driver reads the sample from a table, and tasks count its parts there.
    sample = materialise(parts[0].unionByName(parts[1]), "toxicity-sample")
    toxic, ordinary = (
        without_near_copies([r["_text"] for r in sample.where(F.col("_toxic") == label).orderBy(
            *order, "_text").select("_text").toLocalIterator()])
        for label in (1, 0))
    model = train(toxic, ordinary, odds, found_telling_parts(sample, toxic, ordinary))
    del toxic, ordinary
    give_back()
    return model


def found_telling_parts(sample: DataFrame, toxic: Sequence[str], ordinary: Sequence[str]
                        ) -> dict[int | None, set[bytes]]:
    """`telling_parts` without each fold, and of all texts (None); only parts that may tell reach the driver.

    `sample` has the rows (_text, _toxic) that the toxic and ordinary texts were taken from.
    """
    rates = {f: _toxic_rate(toxic, ordinary, f) for f in (*range(FOLDS), None)}
    if not toxic or not ordinary:
        return {f: set() for f in rates}
    names = [f"n{i}" for i in range(2 * FOLDS)]
    sums = materialise(_counted_parts(sample, toxic, ordinary, names), "toxicity-parts")

    def with_part(label: int, fold: int | None) -> F.Column:
        first = 0 if label else FOLDS
        return sum(F.col(names[first + f]) for f in range(FOLDS) if f != fold)

    met = {f: with_part(1, f) >= LEAST_TEXTS for f in rates}
    totals = sums.agg(*[F.count(F.when(c, 1)) for c in met.values()]).first()
    candidates = dict(zip(met, totals))
    may_tell = F.lit(False)
    for f, rate in rates.items():
        if 0 < rate < 1:
            t, o = with_part(1, f), with_part(0, f)
            n = t + o
            nats = t * (F.log(t) - F.log(n) - float(np.log(rate))) + F.when(
                o > 0, o * (F.log(o) - F.log(n) - float(np.log(1 - rate)))).otherwise(0.0)
            may_tell |= met[f] & (nats >= float(_least_nats(candidates[f])) - ROUNDING_NATS)
    found = sums.where(may_tell).toArrow()
    counts = dict(zip(found.column("part").to_pylist(), zip(*[found.column(n).to_pylist() for n in names])))
    return {f: telling_parts(counts, toxic, ordinary, f, candidates[f]) for f in rates}


def _counted_parts(sample: DataFrame, toxic: Sequence[str], ordinary: Sequence[str], names: Sequence[str]
                   ) -> DataFrame:
    """`count_parts` in tasks, over the rows of the sample whose texts are given: part and numbers."""
    kept = {(label, _digest(t)) for label, texts in ((1, toxic), (0, ordinary)) for t in texts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            rows = zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist())
            counts = count_parts((t, y) for t, y in rows if (y, _digest(t)) in kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()),
                 *[pa.array([n[i] for n in counts.values()], pa.int32()) for i in range(2 * FOLDS)]],
                names=["part", *names])
        give_back()

    tasks = 4 * sample.sparkSession.sparkContext.defaultParallelism
    counted = sample.select("_text", "_toxic").distinct().repartition(tasks).mapInArrow(
        run, "part binary, " + ", ".join(f"{n} int" for n in names))
    return counted.groupBy("part").agg(*[F.sum(n).cast("int").alias(n) for n in names])


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score"
          ) -> DataFrame:
    """Add the score of each whole text, between 0 and 1."""

    def make():
        scorer = model.scorer()
        return lambda column: [pa.array(scorer(column.to_pylist()), pa.float64())]

    return with_columns_from(documents, text, [T.StructField(name, T.DoubleType())], make)


def toxicity(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(documents, labels, text=text)
    scored = score(documents.select("doc_id", F.col(text).alias("_text")), model, "_text", "score")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
