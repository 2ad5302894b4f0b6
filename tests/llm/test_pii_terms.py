"""Terms that disclose an entity, weighed over whole texts, against a plain version."""

import math
import random
import re
from collections import Counter

from brute import personal
from pyspark.sql import functions as F

from millrace.llm import pii

LETTER = "[^\\W\\d_]"
WORD = re.compile(f"(?<!{LETTER}){LETTER}{{4,}}(?!{LETTER})")


def plain(rows):
    """(doc_id, text) to the spans of kind term, over distinct rows; n_rows over all rows."""
    n_rows = Counter(t for _, text in rows for t in {w.group().lower() for w in WORD.finditer(text or "")})
    base = {row: [(k, a, b) for k, a, b in personal(row[1])] for row in set(rows)}
    entities = {row: {(k, row[1][a:b]) for k, a, b in spans} for row, spans in base.items()}
    places = {row: [(w.group().lower(), w.start(), w.end()) for w in WORD.finditer(row[1] or "")
                    if not any(a < w.end() and w.start() < b for _, a, b in base[row])] for row in base}
    n_entity = Counter(e for row in base for e in entities[row])
    both = Counter((e, t) for row in base for e in entities[row] for t in {p[0] for p in places[row]})
    telling = {(e, t) for (e, t), n in both.items()
               if n >= 3 and 2 * n >= n_rows[t] and math.log2(n / n_rows[t] / (n_entity[e] / len(rows))) >= 3}
    return {row: [(a, b) for t, a, b in places[row] if any((e, t) in telling for e in entities[row])] for row in base}


def found(frame):
    return {(r["doc_id"], r["_key"]): [tuple(t) for t in r["term"]] for r in pii.find_spans(frame).collect()}


def test_terms_far_from_their_entity_are_masked_throughout(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, filler(60)) for i in range(60)]
    rows += [(100 + i, f"Wolperting {filler(50)} write to a.b{i % 2}@ex.org {filler(40)} (wolperting) {filler(5)}")
             for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.sanitise(frame).collect():
        assert "olperting" not in r.text and ("[TERM]" in r.text) == (r.doc_id >= 100)
    # Where the entity is not, the term stays.
    more = spark.createDataFrame([*rows, (200, "wolperting alone")], "doc_id long, text string")
    assert {r.text for r in pii.sanitise(more).collect() if r.doc_id == 200} == {"wolperting alone"}


def test_terms_as_in_a_plain_version(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéßİ", k=rng.randint(2, 6))) for _ in range(300)]
    mails = [f"x{i}@mail{i % 7}.org" for i in range(12)] + ["éééé+49 30 123456", "+49 30 123456abcd", "10.1.2.3word"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    for i in range(120):
        at = rng.randrange(12)
        body = rng.choices(words, k=rng.randint(0, 90)) + words[at * 5 : at * 5 + rng.randint(0, 5)]
        body += [mails[at], *rng.sample(mails, rng.randint(0, 3)), *words[-1 - at :]]
        rng.shuffle(body)
        rows.append((1000 + i, rng.choice(" \n").join(body)))
    rows += [rows[310], rows[311], (None, rows[312][1]), (None, None), (310, rows[313][1]), (5000, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r["doc_id"], r["text"]): r["k"] for r in frame.withColumn("k", F.xxhash64("text")).collect()}
    want = {(i, keys[i, t]): spans for (i, t), spans in plain(rows).items()}
    assert sum(map(len, want.values())) > 20
    assert found(frame) == want
