"""Approximate nearest neighbours by balanced posting lists.

1. Centroids are fitted to a bounded sample by k-means with a price on full
   clusters, so that lists come out of about equal length.
2. Centroids (a bounded number) are searched by an in-memory graph: each is
   linked with its nearest ones, and a beam walks the graph towards a vector.
   The walk is done for a whole batch of vectors at a time.
3. Every vector is indexed: posted to its nearest centroid, and, if it lies near
   a boundary, to up to `POST_LISTS` centroids within a distance ratio. Longer
   lists are cut into parts of bounded size, all of which are searched.
4. A query takes the lists whose centroids are within a distance ratio of its
   fourth nearest, and at least the nearest `LEAST_LISTS`. Query and posting meet by list part; each part answers with its
   best, and the best of all parts are the answer.

Nearness is the largest inner product in double precision. Vectors get one more
component that makes all norms equal, so that Euclidean distance orders them the
same way. Equal vectors are indexed once, with the `k + 1` smallest ids, which
is all that an answer can hold of them; equal queries are answered once.

Vectors that are null, empty, zero, or hold nulls or numbers that are not finite
take no part, nor do rows without an id; of several dimensions the most frequent
one (the largest of those) takes part. Fewer candidates than `k` give shorter answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

SAMPLE = 20_000
LIST_VECTORS = 64
MAX_CENTROIDS = 4096
PART_VECTORS = 4096
DEGREE = 24
BEAM = 128
POST_RATIO = 1.2
POST_LISTS = 8
QUERY_RATIO = 1.08
LEAST_LISTS = 32
SALTS = 32
# Two ways to sum a product differ by less than this share of the norms.
_ROUNDING = 1e-10


@dataclass
class Centroids:
    points: np.ndarray
    links: np.ndarray
    norm: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more component, so that all indexed vectors have the same norm."""
        left = np.zeros(len(x)) if query else np.sqrt(
            np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        scale = 1.0
        if query:  # the length of a query does not change the order
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            scale = (self.norm / n)[:, None]
        return np.column_stack([x * scale, left])

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the beam for each row, nearest first."""
        n, c = len(x), len(self.points)
        beam = min(beam, c)
        square = np.einsum("ij,ij->i", self.points, self.points)
        entries = np.unique(np.linspace(0, c - 1, min(c, 16)).astype(int))
        rows = np.arange(n)[:, None]
        far = np.inf

        def distance(ids: np.ndarray) -> np.ndarray:
            return square[ids] - 2 * np.einsum("nkd,nd->nk", self.points[ids], x)

        ids = np.tile(entries, (n, 1))
        dist = distance(ids)
        seen = np.zeros((n, c), dtype=bool)
        seen[rows, ids] = True
        done = np.zeros((n, c), dtype=bool)
        for _ in range(4 * beam):
            open_ = np.where(done[rows, ids], far, dist)
            best = np.argmin(open_, axis=1)
            live = open_[rows[:, 0], best] < far
            if not live.any():
                break
            chosen = ids[rows[:, 0], best]
            done[rows[:, 0], chosen] = True
            near = self.links[chosen]
            new = ~seen[rows, near] & live[:, None]
            seen[rows, near] |= live[:, None]
            d = np.where(new, distance(near), far)
            ids, dist = np.hstack([ids, near]), np.hstack([dist, d])
            if ids.shape[1] > beam:
                top = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist = np.take_along_axis(ids, top, 1), np.take_along_axis(dist, top, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        plus = np.einsum("ij,ij->i", x, x)[:, None]
        return ids, np.sqrt(np.maximum(0.0, dist + plus))


def fit_centroids(sample: np.ndarray, total: int, norm: float, list_vectors: int = LIST_VECTORS,
                  rounds: int = 12) -> Centroids:
    """Balanced k-means over a sample of lifted vectors; links to the nearest centroids."""
    lifted = Centroids(np.zeros((0, 0)), np.zeros((0, 0)), norm).lift(sample)
    c = int(np.clip(total // list_vectors, 1, min(MAX_CENTROIDS, len(lifted))))
    rng = np.random.default_rng(7)
    points = lifted[rng.permutation(len(lifted))[:c]].copy()
    price = np.zeros(c)
    spread = max(1e-12, float(lifted.var(axis=0).sum()))
    for _ in range(rounds):
        which = np.empty(len(lifted), dtype=np.int64)
        for i in range(0, len(lifted), 4096):
            x = lifted[i : i + 4096]
            which[i : i + 4096] = np.argmin(
                (points**2).sum(axis=1) - 2 * x @ points.T + price, axis=1)
        count = np.bincount(which, minlength=c)
        sums = np.zeros_like(points)
        np.add.at(sums, which, lifted)
        full = count > 0
        points[full] = sums[full] / count[full, None]
        price += 0.02 * spread * (count / max(1.0, len(lifted) / c) - 1)
    square = (points**2).sum(axis=1)
    d = square[:, None] + square - 2 * points @ points.T
    np.fill_diagonal(d, np.inf)
    degree = min(DEGREE, max(1, c - 1))
    links = np.argsort(d, axis=1, kind="stable")[:, :degree] if c > 1 else np.zeros((1, 1), int)
    # A ring through all keeps the graph in one piece.
    ring = ((np.arange(c) + 1) % c)[:, None]
    return Centroids(points, np.hstack([links, ring]), norm)


def _reference(dist: np.ndarray, place: int) -> np.ndarray:
    """The distance that ratios are taken of: that of the centroid at `place`.

    The nearest one would not do: where it is the vector itself, a ratio of
    nothing would leave out all other lists.
    """
    place = min(place, dist.shape[1] - 1)
    return dist[:, place : place + 1]


def lists_of(centroids: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the centroids each vector is posted to."""
    ids, dist = centroids.search(centroids.lift(x), 4 * POST_LISTS)
    near = dist <= _reference(dist, 1) * POST_RATIO + 1e-12
    near[:, POST_LISTS:] = False
    return np.nonzero(near)[0], ids[near]


def query_lists(centroids: Centroids, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists a query reads, those within the distance ratio."""
    ids, dist = centroids.search(centroids.lift(q, query=True))
    near = dist <= _reference(dist, 3) * QUERY_RATIO + 1e-12
    near[:, :LEAST_LISTS] = True
    return np.nonzero(near)[0], ids[near]


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & finite
        & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component.
    return rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): equal vectors as one, with their `keep` smallest ids in order.

    First within groups of tasks, then over all: a vector that holds a large
    share of the rows sends a few ids from each group only.
    """
    some = Window.partitionBy("v", "_salt").orderBy("id")
    all_ = Window.partitionBy("v").orderBy("id")
    return (
        rows.withColumn("_salt", F.spark_partition_id() % SALTS)
        .withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= keep)
        .withColumn("_r", F.row_number().over(all_)).where(F.col("_r") <= keep)
        .groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )


def _post(rows: DataFrame, make_lists, columns: str) -> DataFrame:
    """Explode rows to the lists that `make_lists` names for their vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows, lists = make_lists(_matrix(part.column("v")))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(take) for c in part.columns], pa.array(lists.astype(np.int32))],
                    names=[*part.schema.names, "list"])

    return rows.mapInArrow(run, columns + ", list int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each query, without itself."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = sizes["d"] if sizes else 1
    rows = rows.where(F.size("v") == dimension)
    index = materialise(distinct_vectors(rows, k + 1), "ann-vectors")
    asked = usable(queries, id_col, vector).where(F.size("v") == dimension)
    asked = materialise(asked, "ann-queries")

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, norm = index.agg(F.count("*"), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    picked = index.select("v", F.xxhash64("v").alias("_h")).orderBy("_h").limit(SAMPLE).select("v")
    sample = _matrix(picked.toArrow().column("v").combine_chunks())
    fitted = fit_centroids(sample, n, norm)
    centroids = spark.sparkContext.broadcast((fitted.points, fitted.links, fitted.norm))

    posted = _post(index, lambda x: lists_of(Centroids(*centroids.value), x), "v array<double>, ids array<long>")
    posted = materialise(posted, "ann-postings")
    counts = posted.groupBy("list").agg(
        F.ceil(F.count("*") / F.lit(PART_VECTORS)).cast("int").alias("parts"))
    parts = F.broadcast(counts)  # one row per centroid, of which there are MAX_CENTROIDS at most
    postings = posted.join(parts, "list").select(
        "list", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"),
        F.lit(None).cast("long").alias("query"), "v", "ids")

    once = asked.groupBy("v").agg(F.min("id").alias("query"))
    reads = _post(once, lambda x: query_lists(Centroids(*centroids.value), x), "v array<double>, query long")
    reads = reads.join(parts, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "v",
        F.lit(None).cast("array<long>").alias("ids"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, matrix = None, [], [], None
        for batch in batches:
            places = list(zip(batch.column("list").to_pylist(), batch.column("part").to_pylist()))
            is_query = np.asarray(batch.column("query").is_valid())
            x = _matrix(batch.column("v"))
            i = 0
            while i < len(places):
                j = i
                while j < len(places) and places[j] == places[i] and is_query[j] == is_query[i]:
                    j += 1
                if places[i] != key:
                    key, held, ids, matrix = places[i], [], [], None
                if not is_query[i]:
                    held.append(x[i:j])
                    ids += batch.column("ids").slice(i, j - i).to_pylist()
                    matrix = None
                elif held:
                    if matrix is None:
                        matrix = np.vstack(held)
                        held = [matrix]
                    yield _best(batch.column("query").slice(i, j - i).to_pylist(), x[i:j], matrix, ids, k + 1)
                i = j

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        postings.union(reads).repartition(partitions, "list", "part")
        .sortWithinPartitions("list", "part", F.col("query").isNotNull())
        .mapInArrow(answer, "query long, ids array<long>, score double")
    )
    # The same vector may come from several lists.
    each = found.groupBy("query", F.col("ids")[0].alias("first")).agg(
        F.max(F.struct("score", "ids")).alias("f"))
    each = each.select("query", "f.score", F.explode("f.ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        each.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("found"))
    )
    asked_once = asked.dropDuplicates(["id", "v"]).join(once, "v").select(
        F.col("id").alias("query_id"), "query")
    others = asked_once.join(answers, "query").select(
        "query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("_at", "f")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"),
        F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _best(queries: list[int], q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> pa.RecordBatch:
    """The k best of a part for each query; scores summed the same way for equal vectors.

    All that may be as good as the k-th by the quick product are scored exactly,
    however many they are.
    """
    rough = q @ x.T
    m = min(len(x), k)
    least = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
    norms = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x).max())
    least -= _ROUNDING * norms
    out_q, out_ids, out_s = [], [], []
    for row, query in enumerate(queries):
        top = np.flatnonzero(rough[row] >= least[row])
        scores = (x[top] * q[row]).sum(axis=1)
        ranked = sorted(zip((-scores).tolist(), [ids[t] for t in top.tolist()]))[:k]
        out_q += [query] * len(ranked)
        out_s += [-s for s, _ in ranked]
        out_ids += [i for _, i in ranked]
    return pa.RecordBatch.from_arrays(
        [pa.array(out_q, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())),
         pa.array(out_s, pa.float64())], names=["query", "ids", "score"])
