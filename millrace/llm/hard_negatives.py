"""Hard negatives by a multiway hyperplane tree in the manner of GNAT.

An anchor's positives are the rows of its label that score best with it; hard
negatives are rows of other labels that score nearly as well as a positive, within
a window below its score. Scores are inner products of whole numbers, and exact.

*Distances.* All vectors get one more component that makes their norms equal to R, and
an anchor is stretched to norm R; then d(a, x)^2 = 2 R^2 - 2 score R / |a|, so a window
of scores is an annulus around the anchor.

*Tree.* A node has up to `FAN_OUT` split points, far from each other; a vector goes
to the child of its nearest split point. The split points are taken from a bounded
sample (`SAMPLE` vectors), and the tree has no more leaves than the sample allows;
but every vector is in a leaf, and for each split point i and child j of a node the
tree holds the least and largest distance from i to *any* vector below j, gathered
over all vectors in Spark.

*Search.* An anchor measures its distances to a node's split points. By the triangle
inequality each of them bounds the distance of everything below each child; a child
none of whose vectors can be in the annulus is eliminated. Leaves that follow each
other in the tree make a part, large ones several (see `part_rows`); an anchor goes once
to each part with a surviving leaf, by a shuffle, and vectors there are scored exactly. The annulus is narrow from the start: the sample already says how
good the last of the wanted rows must be at least. What is eliminated cannot hold an
answer, so results are exact, whatever the sample.

Rows that agree in vector and label are one entry with their `KEEP` smallest ids,
which is all that an answer can hold of them; anchors that agree are searched once.

Rows without an id, a label or a vector, with an empty vector or with a null or
non-finite component take no part; nor do rows whose scores may not fit into a long
(a component beyond `largest_component`), nor, of several dimensions, those that do
not have the most frequent one (ties: the larger). Rows equal in id, label and vector
are one row; rows that share an id only are different rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import give_back, materialise

SAMPLE = 20_000
FAN_OUT = 16
LEAF_ROWS = 256
# Parts of the table, if they are not larger than this: vectors, and bytes of components.
PARTS = 128
PART_ROWS = 1 << 15
PART_BYTES = 16 << 20
# Scores taken at once.
CELLS = 1 << 21
POSITIVES = 5
NEGATIVES = 5
# Of equal rows: as many ids as an answer has, and the anchor's own.
KEEP = max(POSITIVES, NEGATIVES) + 1
# Distances are doubles; bounds are taken wider by this share of the largest one.
SLACK = 1e-6


def largest_component(dimension: int) -> int:
    """Products of such vectors fit into a long, with room to spare."""
    return int((2.0**62 / max(1, dimension)) ** 0.5)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             label: str = "label", factor: float = 256.0) -> DataFrame:
    """(id, label, v): the rows that take part, components as whole numbers."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(factor))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    bound = F.floor(F.sqrt(F.lit(2.0**62) / F.size("v")))
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < bound), F.lit(False)))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(fits)
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x)).alias("v"))


def entries_of(rows: DataFrame) -> DataFrame:
    """(v, label, ids): rows that agree as one, with their KEEP smallest ids in order.

    First within groups of tasks, then over all: a vector with a large share of
    the rows sends a few ids from each group only.
    """
    some = Window.partitionBy("v", "label", "_salt").orderBy("id")
    all_ = Window.partitionBy("v", "label").orderBy("id")
    return (
        rows.withColumn("_salt", F.spark_partition_id() % 32)
        .dropDuplicates(["v", "label", "_salt", "id"])
        .withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= KEEP)
        .dropDuplicates(["v", "label", "id"])
        .withColumn("_r", F.row_number().over(all_)).where(F.col("_r") <= KEEP)
        .groupBy("v", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


@dataclass
class Node:
    points: np.ndarray  # split points, lifted
    children: list  # Node, or the number of a leaf
    number: int
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


@dataclass
class Tree:
    root: Node | int
    radius: float
    nodes: list[Node]
    leaves: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more component, by which all indexed vectors have norm `radius`."""
        square = np.einsum("ij,ij->i", x, x)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.radius**2 - square))])

    def stretch(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of norm `radius` among the lifted vectors, and how much they were stretched."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        by = self.radius / np.where(norm > 0, norm, np.inf)
        return np.column_stack([x * by[:, None], np.zeros(len(x))]), by

    def distance_of(self, score: np.ndarray, lifted: np.ndarray, by: np.ndarray) -> np.ndarray:
        """How far a vector is from a stretched anchor, by its score with the anchor."""
        square = np.einsum("ij,ij->i", lifted, lifted) + self.radius**2
        return np.sqrt(np.maximum(0.0, square - 2.0 * score * by))

    def descend(self, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
        """The leaf of each lifted vector; widens `ranges` by their distances on the way."""
        leaf = np.zeros(len(x), dtype=np.int32)

        def walk(node: Node | int, at: np.ndarray) -> None:
            if isinstance(node, int):
                leaf[at] = node
                return
            d = distances(x[at], node.points)
            which = d.argmin(axis=1)
            for j, child in enumerate(node.children):
                below = which == j
                if below.any():
                    if ranges is not None:
                        low, high = d[below].min(axis=0), d[below].max(axis=0)
                        before = ranges.get((node.number, j))
                        ranges[node.number, j] = (low, high) if before is None else (
                            np.minimum(low, before[0]), np.maximum(high, before[1]))
                    walk(child, at[below])

        walk(self.root, np.arange(len(x)))
        return leaf

    def leaves_within(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): leaves that may hold vectors between `near` and `far` from each lifted row."""
        rows, leaves = [], []
        slack = SLACK * (2 * self.radius + 1)

        def walk(node: Node | int, at: np.ndarray) -> None:
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node, dtype=np.int32))
                return
            d = distances(x[at], node.points)[:, :, None]
            least = np.maximum(node.low - d, d - node.high).max(axis=1)
            most = (node.high + d).min(axis=1)
            alive = (least <= far[at][:, None] + slack) & (most >= near[at][:, None] - slack)
            for j, child in enumerate(node.children):
                if alive[:, j].any():
                    walk(child, at[alive[:, j]])

        walk(self.root, np.arange(len(x)))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (
            np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)
    return np.sqrt(np.maximum(0.0, square - 2 * x @ points.T))


def plant(sample: np.ndarray, radius: float, leaf_sample: float, fan_out: int = FAN_OUT) -> Tree:
    """A tree whose leaves have about `leaf_sample` vectors of the sample."""
    rng = np.random.default_rng(11)
    tree = Tree(0, radius, [], 0)
    x = tree.lift(sample)

    def grow(at: np.ndarray) -> Node | int:
        if len(at) <= max(2.0, leaf_sample):
            return leaf()
        some = x[rng.permutation(at)[: 3 * fan_out]]
        wanted = int(np.clip(np.ceil(len(at) / leaf_sample), 2, fan_out))
        chosen = [0]
        apart = distances(some, some)
        while len(chosen) < min(wanted, len(some)):
            least = apart[:, chosen].min(axis=1)
            if least.max() <= 0:
                break
            chosen.append(int(least.argmax()))
        points = some[chosen]
        which = distances(x[at], points).argmin(axis=1)
        if len(set(which.tolist())) < 2:
            return leaf()
        node = Node(points, [], len(tree.nodes))
        tree.nodes.append(node)
        node.children = [grow(at[which == j]) for j in range(len(points))]
        return node

    def leaf() -> int:
        tree.leaves += 1
        return tree.leaves - 1

    tree.root = grow(np.arange(len(x)))
    return tree


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where no sum reaches 2^53, else by longs."""
    most = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    if most * x.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


@dataclass
class Index:
    """The tree, the sample's bounds and the entries by leaf part."""

    tree: object  # a broadcast of (Tree, sample vectors, sample labels, Parts)
    entries: DataFrame
    parts: DataFrame  # leaf, first, n: the parts that hold a leaf


@dataclass
class Parts:
    """Parts `first[b]` to `first[b] + n[b] - 1` hold the leaves of group b."""

    group: np.ndarray  # of each leaf
    first: np.ndarray
    n: np.ndarray


def part_rows(n: int, dimension: int, leaf_rows: int) -> int:
    """How many vectors a part has, about: a query travels to each part that may answer it."""
    return max(1, min(PART_ROWS, PART_BYTES // (8 * dimension), max(leaf_rows, -(-n // PARTS))))


def parts_of(sizes: np.ndarray, most: int) -> Parts:
    """Leaves of these sizes as groups of `most` vectors; a larger leaf is a group of several parts."""
    group, held = np.zeros(len(sizes), dtype=np.int64), []
    for leaf, size in enumerate(sizes.tolist()):
        if not held or held[-1] + size > most:
            held.append(0)
        held[-1] += size
        group[leaf] = len(held) - 1
    n = np.maximum(1, -(-np.array(held, dtype=np.int64) // most))
    return Parts(group, np.cumsum(n) - n, n)


def index_of(entries: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE) -> Index | None:
    """Plant the tree, put every entry into a leaf, and gather all ranges of distances."""
    spark = entries.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, most = entries.agg(F.count("*"), F.max(square)).first()
    if not n:
        return None
    # Rows that cannot be among the first by hash, as good as surely, are not sorted.
    within = int(-(1 << 63) + min(1.0, 1.2 * (sample_rows + 1000) / n) * ((1 << 64) - 2048))
    picked = entries.select("v", "label", F.xxhash64("v", "label").alias("_h")).where(
        F.col("_h") <= within).orderBy("_h").limit(sample_rows)
    taken = picked.select("v", "label").toArrow()
    sample = matrix(taken.column("v").combine_chunks())
    labels = taken.column("label").to_numpy()
    # The lifted component is a root of a difference: keep it real.
    radius = float(np.sqrt(most) * (1 + 1e-9))
    tree = plant(sample.astype(np.float64), radius, leaf_rows * len(sample) / n)
    bare = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = bare.value
        for batch in batches:
            leaf = tree.descend(tree.lift(matrix(batch.column("v")).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = materialise(
        entries.mapInArrow(place, "v array<long>, label long, ids array<long>, leaf int"), "gnat-entries")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ranges = bare.value, {}
        for batch in batches:
            tree.descend(tree.lift(matrix(batch.column("v")).astype(np.float64)), ranges)
        found = [(node, i, j, float(low[i]), float(high[i])) for (node, j), (low, high) in ranges.items()
                 for i in range(len(low))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)],
            names=["node", "i", "j", "low", "high"])

    # As many rows as the tree has pairs of split points, and no more.
    ranges = placed.select("v").mapInArrow(measure, "node int, i int, j int, low double, high double").groupBy(
        "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    for node in tree.nodes:
        size = len(node.points)
        node.low, node.high = np.full((size, size), np.inf), np.full((size, size), -np.inf)
    for at, i, j, low, high in zip(*[ranges.column(c).to_numpy() for c in ("node", "i", "j", "low", "high")]):
        tree.nodes[at].low[i, j], tree.nodes[at].high[i, j] = low, high
    # As many rows as the tree has leaves, which are no more than the sample has vectors.
    counted = placed.groupBy("leaf").count().toArrow()
    sizes = np.zeros(tree.leaves or 1, dtype=np.int64)
    sizes[counted.column("leaf").to_numpy()] = counted.column("count").to_numpy()
    parts = parts_of(sizes, part_rows(n, sample.shape[1], leaf_rows))
    of_leaf = pa.table({"leaf": pa.array(range(len(sizes)), pa.int32()), "first": pa.array(parts.first[parts.group]),
                        "n": pa.array(parts.n[parts.group])})
    return Index(spark.sparkContext.broadcast((tree, sample, labels, parts)), placed, spark.createDataFrame(of_leaf))


def search(index: Index, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, high, score, id, own): the `k` best rows for each query and window, best first in `_r`.

    `wanted` has query, v, label and windows (low and high score, both allowed, null
    for no bound) of each query. Candidates have the query's label if `same`, else
    another one. The query's own rows, those with its vector and label, are marked `own`.
    """
    sent = index.tree
    order = [F.desc("score"), "id"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample, labels, parts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column("v"))
                label = part.column("label").to_numpy(zero_copy_only=False)
                points = scores(sample, x)
                allowed = (labels[None, :] == label[:, None]) == same
                rows, lows, highs = [], [], []
                for i, windows in enumerate(part.column("windows").to_pylist()):
                    known = points[i][allowed[i]]
                    for w in windows:
                        low, high = _ends(w)
                        inside = known[(known >= low) & (known <= high)]
                        # The sample has k rows that are as good: no answer is below them.
                        if len(inside) >= k:
                            low = max(low, int(np.partition(inside, len(inside) - k)[len(inside) - k]))
                        rows.append(i)
                        lows.append(low)
                        highs.append(high)
                if not rows:
                    continue
                rows, lows, highs = (np.array(a, dtype=np.int64) for a in (rows, lows, highs))
                lifted, by = (a[rows] for a in tree.stretch(x.astype(np.float64)))
                far, near = (tree.distance_of(s, lifted, by) for s in (lows, highs))
                which, leaves = tree.leaves_within(lifted, near, far)
                # All windows of a query that a part may answer go there together.
                found: dict[tuple[int, int], list] = {}
                groups = len(parts.n)
                for pair in np.unique(which * groups + parts.group[leaves]).tolist():
                    w, group = divmod(pair, groups)
                    found.setdefault((int(rows[w]), group), []).append({"low": int(lows[w]), "high": int(highs[w])})
                at_group = np.array([g for _, g in found], dtype=np.int64)
                n = parts.n[at_group]
                # A group has all its parts' numbers in a row.
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(parts.first[at_group], n)
                again = pa.array(np.repeat(np.arange(len(found)), n))
                take = pa.array([i for i, _ in found], pa.int64()).take(again)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query").take(take), part.column("v").take(take), part.column("label").take(take),
                     pa.array(list(found.values()), part.column("windows").type).take(again), pa.array(number)],
                    names=["query", "v", "label", "windows", "part"])

    windows = "array<struct<low:bigint,high:bigint>>"
    asked = wanted.select("query", "v", "label", "windows")
    # Never a side of a join: Spark takes these rows for as few as the queries.
    reads = asked.repartition(_partitions(asked), "query").mapInArrow(
        route, f"query long, v array<long>, label long, windows {windows}, part long").withColumn(
        "ids", F.lit(None).cast("array<long>"))
    held = index.entries.join(F.broadcast(index.parts), "leaf").select(
        F.lit(None).cast("long").alias("query"), "v", "label", F.lit(None).cast(windows).alias("windows"),
        (F.col("first") + F.pmod(F.xxhash64("v", "label"), F.col("n"))).alias("part"), "ids")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x = None, [], None
        for batch in batches:
            places = batch.column("part").to_numpy()
            asks = np.asarray(batch.column("query").is_valid())
            ends = [*(np.flatnonzero((places[1:] != places[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(places)]
            for i, j in zip([0, *ends], ends):
                if places[i] != key:
                    key, held, x = places[i], [], None
                some = batch.slice(i, j - i)
                if not asks[i]:
                    held.append(some.select(["v", "label", "ids"]))
                    x = None
                elif held:
                    if x is None:
                        x = _entries(held)
                    step = max(1, CELLS // len(x[0]))
                    for at in range(0, j - i, step):
                        yield _best(some.slice(at, step), *x, k, same)
        give_back()

    found = (
        held.unionByName(reads).repartition(_partitions(asked), "part")
        .sortWithinPartitions("part", F.col("query").isNotNull())
        .mapInArrow(answer, "query long, high long, score long, ids array<long>, own boolean")
    )
    each = found.select("query", "high", "score", "own", F.explode("ids").alias("id"))
    best = Window.partitionBy("query", "high").orderBy(*order)
    return each.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ends(window: dict) -> tuple[int, int]:
    low, high = window["low"], window["high"]
    return (-(1 << 62) if low is None else low), ((1 << 62) if high is None else high)


def _entries(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    ids = [i for b in held for i in b.column("ids").to_pylist()]
    return (np.vstack([matrix(b.column("v")) for b in held]),
            np.concatenate([b.column("label").to_numpy(zero_copy_only=False) for b in held]),
            np.array([i[0] for i in ids], dtype=np.int64), ids)


def _best(asked: pa.RecordBatch, x: np.ndarray, labels: np.ndarray, first: np.ndarray, ids: list,
          k: int, same: bool) -> pa.RecordBatch:
    """The k best entries of a part for each query and window; equal scores by their first id.

    They hold the k best ids: before each of them in this order is an entry whose
    first id is better.
    """
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    q = matrix(asked.column("v"))
    points = scores(x, q)
    label = asked.column("label").to_numpy(zero_copy_only=False)
    each = [[_ends(w) for w in windows] for windows in asked.column("windows").to_pylist()]
    least, most = (np.array([f(e[i] for e in ends) for ends in each]) for i, f in ((0, min), (1, max)))
    rows, places = np.nonzero(((labels[None, :] == label[:, None]) == same)
                              & (points >= least[:, None]) & (points <= most[:, None]))
    begins = np.searchsorted(rows, np.arange(len(q) + 1))
    for row, (query, ends) in enumerate(zip(asked.column("query").to_pylist(), each)):
        may = places[begins[row] : begins[row + 1]]
        if not len(may):
            continue
        mine = points[row]
        may = may[np.lexsort((first[may], -mine[may]))]
        for low, high in ends:
            inside = may[(mine[may] >= low) & (mine[may] <= high)][:k].tolist()
            out[0].extend([query] * len(inside))
            out[1].extend([high] * len(inside))
            out[2].extend(mine[inside].tolist())
            out[3].extend(ids[i] for i in inside)
            out[4].extend(same and bool((x[i] == q[row]).all()) for i in inside)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(o, kind) for o, kind in zip(out, kinds)], names=["query", "high", "score", "ids", "own"])


SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, "
          "positive_score long, negative_score long")


def hard_negatives(rows: DataFrame, is_anchor: Column, least_share: tuple[int, int] = (80, 100),
                   leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id and scores.

    `rows` as from `prepared`; `is_anchor` says of an id whether it is an anchor's.
    A negative's score is at most the positive's and at least `least_share` of it.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("v") == sizes["d"])
    index = index_of(materialise(entries_of(rows), "gnat-distinct"), leaf_rows, sample_rows)
    anchors = rows.where(is_anchor).select(F.col("id").alias("anchor_id"), "label", "v").distinct()
    # Anchors may share an id, so queries have a number of their own.
    anchors = materialise(anchors.withColumn("query", F.xxhash64("label", "v")), "gnat-anchors")
    once = materialise(anchors.select("query", "label", "v").distinct(), "gnat-queries")
    asked = anchors.select("anchor_id", "query")

    free = F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    near = search(index, once.withColumn("windows", F.array(free)), POSITIVES + 1, True)
    by_anchor = Window.partitionBy("anchor_id", "query").orderBy("_r")
    itself = F.col("own") & (F.col("id") == F.col("anchor_id"))
    positives = asked.join(near, "query").where(~itself).withColumn(
        "_p", F.row_number().over(by_anchor)).where(F.col("_p") <= POSITIVES)
    positives = materialise(positives.select(
        "anchor_id", "query", "_p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "gnat-positives")

    part, whole = least_share
    score = F.col("positive_score")
    # The least whole number that is at least the share of the score.
    least = F.call_function("div", score.cast("decimal(19,0)") * part + (whole - 1), F.lit(whole).cast("decimal(10,0)"))
    window = positives.where(score >= 0).groupBy("query").agg(
        F.array_sort(F.collect_set(F.struct(least.alias("low"), score.alias("high")))).alias("windows"))
    # Vectors in a file are a few times smaller than in a broadcast.
    near = search(index, once.join(window.hint("merge"), "query"), NEGATIVES, False)
    by_pair = Window.partitionBy("anchor_id", "query", "positive_id", "_p").orderBy("_r")
    found = positives.join(near.withColumnRenamed("high", "positive_score"), ["query", "positive_score"]).withColumn(
        "rank", F.row_number().over(by_pair))
    return found.where(F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
