"""Connected components of a graph given as a table of links.

Alternates two steps until the links no longer change: every node hands the
smallest node it knows to its larger neighbours, then to its smaller ones. Each
round halves the distances, roughly; its links are written to a table in the
shared folder. Degrees may be as large as they like: a node's smallest
neighbour is found by a pre-aggregated minimum, and joins on a hot node can be
split, since no row of a node needs the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

MAX_ROUNDS = 50


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest reachable node.

    Links of a node to itself, repeated links and either direction are allowed.
    Links with a null end count for nothing.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
    )
    seen = _mark(edges)
    for _ in range(MAX_ROUNDS):
        edges = materialise(_small_star(_large_star(edges)), "links")
        mark = _mark(edges)
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        seen = mark
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("u", "v") % 1000003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of u are linked with the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
