"""Source divergence against a plain version."""

import random

import numpy as np
import pytest
from brute import divergence as plain

from millrace.llm import divergence as D

FORM = "doc_id long, text string, lang string, source string, term string, docs string, part string"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(n, *r, "own", "own", "own") for n, r in enumerate(rows)], FORM).repartition(3)
    return sorted(map(tuple, D.divergence(frame, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The,", "(the)", "the.the", "a1b", "é", "\u00a0x", "straße", "STRASSE", "x-y_z", "3", "...", "ÀB"]
    words += [f"w{chr(97 + i)}" for i in range(20)]
    made = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]),
             rng.choice(["a", "b", None, "é", "z"])) for _ in range(150)]
    made += [(None, "en", "a"), ("", "en", "only empty"), ("...", "fr", "b"), ("one", "fr", "c"), (None, None, None)]
    made += [("the," * 3000, "en", "a"), ("the " * 700, "de", "b"), ("x" * 9000, "en", "b"), ("a." * 5000, "en", "c")] * 2
    made += [made[3]] * 40
    return made


def test_odd_texts(spark, rows):
    assert run(spark, rows) == sorted(plain(rows))
    assert run(spark, rows, least_docs=2, top=3) == sorted(plain(rows, 2, 3))


def test_parts_and_blocks_of_any_size(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "PART_DOCS", 7)
    monkeypatch.setattr(D, "BLOCK", 16)
    assert run(spark, rows) == sorted(plain(rows))


def test_a_document_counts_a_term_once_in_however_many_chunks(spark):
    rows = [("the The (the) the,the", "en", "a")] * 9 + [("it", "en", "a")] * 10
    frame = spark.createDataFrame([(t, lang, 5) for t, lang, _ in rows], "text string, lang string, sid long")
    counts = {r.term: (r.docs, r.times, bytes(r.counts)) for r in D.term_counts(frame, 1).collect()}
    assert counts == {"the": (9, 45, (45).to_bytes(8, "little")), "it": (10, 10, (10).to_bytes(8, "little"))}
    assert not [r for r in run(spark, rows) if r[3] == "the"]


def test_empty(spark):
    assert run(spark, []) == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(D._share(F.lit(5 * 10**17), F.lit(9 * 10**17), F.lit(10**6)).alias("p"))
    assert one.first()["p"] == 1 + 10**9 * (5 * 10**17 + 2) // (9 * 10**17 + 2 * 10**6)


def test_both_ways_to_a_share_agree():
    counts, totals = np.array([0, 5, 5 * 10**17]), np.array([7, 9, 9 * 10**17])
    assert D.shares(counts, totals, 3).tolist() == [
        1 + 10**9 * (c + 2) // (t + 6) for c, t in zip(counts.tolist(), totals.tolist())]
    assert D.shares(counts[:2], totals[:2], 3).tolist() == D.shares(counts, totals, 3).tolist()[:2]
