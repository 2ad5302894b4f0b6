"""What is made larger than Spark reckons is not sent to the driver, however small it is here."""

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as H
from millrace.llm import simhash
from millrace.llm.common import materialise


def final_plan(rows):
    """The plan as adaptive execution left it."""
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_postings_of_fingerprints_are_not_broadcast(spark):
    prints = spark.range(300).select(F.xxhash64("id").alias("_fp"))
    near = prints.select(F.col("_fp").bitwiseXOR(F.lit(5)).alias("_fp"))
    links = simhash.linked_fingerprints(prints.union(near))
    plan = final_plan(links)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert links.distinct().count() == 300


def below_broadcasts(plan):
    """The lines of a plan that lie below a broadcast."""
    out, edge = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        edge = None if edge is not None and depth <= edge else edge
        if edge is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            edge = depth
    return out


def test_routed_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-90, 90, (3000, 8))
    rows = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x.tolist())], "id long, label long, v array<long>")
    index = H.index_of(materialise(H.entries_of(rows), "entries"), leaf_rows=4)
    free = F.array(F.struct(*[F.lit(None).cast("long").alias(c) for c in ("low", "high")]))
    asked = materialise(rows.where("id % 150 = 0").coalesce(1).withColumn("windows", free).withColumnRenamed("id", "query"), "asked")
    near = H.search(index, asked, 3, True)
    lines = below_broadcasts(final_plan(near))
    assert lines and not any("route(" in line for line in lines)
    score = x[::150] @ x.T
    score[:, np.arange(3000) % 3 != 0] = -(1 << 40)
    got = sorted((r["query"], -r["score"]) for r in near.collect())
    assert got == sorted((150 * i, -s) for i, row in enumerate(score) for s in np.sort(row)[-3:].tolist())


def test_leaves_that_follow_each_other_make_parts():
    parts = H.parts_of(np.array([3, 4, 0, 25, 2, 9, 1]), 10)
    assert parts.group.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert parts.first.tolist() == [0, 1, 4, 5] and parts.n.tolist() == [1, 3, 1, 1]
    # A query goes to no more parts than PARTS, until a part would be too large to hold.
    assert H.part_rows(10_000, 64, 256) == 256 and H.part_rows(1_000_000, 64, 256) == 7813
    assert H.part_rows(1 << 40, 64, 256) == 1 << 15 and H.part_rows(1 << 40, 4096, 256) == 512


def test_names_of_kept_documents_are_not_broadcast(spark):
    texts = [f"{'abcdefgh'[i % 8]}{i} of a text that is like no other {i * i} {i ^ 55}" for i in range(150)]
    made = [(i, texts[i % 150]) for i in range(300)]
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), "")
    plan = final_plan(kept)
    assert "LeftSemi" in plan and "SortMergeJoin" in plan
    assert not any("BroadcastHashJoin" in line and "LeftSemi" in line for line in plan.splitlines())
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) <= 150 and max(got) < 150
