"""Language identification: held-out rows, a plain version of the n-grams, odd texts."""

import zlib

import numpy as np
import pytest
from brute import ngrams

from millrace.llm import language as L
from millrace.llm import queries

ODD = [None, "", " ", "123 !?", "a", "A\nb", "x\n\n\ny", "\nx\n", "É à\u00a0ü", "..a..b..", "word " * 50, "İstanbul", "中文 text", "\x00q"]


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    got = {r.doc_id: r for r in queries.op13_language(spark, folder).collect()}
    assert len(got) == len(documents)
    held = [(r.lang, got[r.doc_id].lang_pred) for r in documents if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(a == b for a, b in held) / len(held) > 0.99
    for lang in ("en", "de", "fr", "es"):
        one = [a == b for a, b in held if a == lang]
        assert sum(one) / len(one) > 0.98


def hashes(text):
    return sorted(L.grams([text])[1].tolist())


def test_ngrams_are_those_of_the_plain_version():
    known: dict = {}
    owner, found = L.grams(ODD)
    for i, text in enumerate(ODD):
        plain, mine = ngrams(text), found[owner == i].tolist()
        assert len(plain) == len(mine)
        # By size, in order of the text: one number for each n-gram, and one n-gram for each number.
        for a, b in zip(plain, mine):
            assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 10)
    assert hashes("one two three four") == sorted(hashes("one two") + hashes(" three") + hashes("four"))
    assert len(hashes("x" * 35)) == len(hashes("x" * 10)) * 3 + len(hashes("x" * 5))


@pytest.fixture(scope="module")
def small():
    texts = {"aa": "lorem ipsum dolor", "bb": "zwölf boxkämpfer", "cc": "lorem zwölf"}
    known = {name: np.unique(L.grams([text])[1]) for name, text in texts.items()}
    return texts, L.LanguageFilter.build(known, "bb")


def test_masks_name_all_languages_that_hold_an_ngram(small):
    texts, filter_ = small
    for i, text in enumerate(texts.values()):
        assert ((filter_.masks(L.grams([text])[1])[0] >> i) & 1).all()
    corrected, n = filter_.counts(list(texts.values()))
    for i, text in enumerate(texts.values()):
        plain = ngrams(text)
        assert n[i] == len(plain)
        for j, other in enumerate(texts.values()):
            true = sum(g in set(ngrams(other)) for g in plain)
            assert abs(corrected[i, j] - true) <= 2
    assert filter_.decide(list(texts.values()))[0] == ["aa", "bb", "cc"]
    assert filter_.decide(["qqq", "", None, "7"]) [0] == ["bb", "und", "und", "und"]


def test_many_languages_take_more_words():
    rng = np.random.default_rng(1)
    known = {f"l{i:03}": rng.integers(0, 2**63, 50).astype(np.uint64) for i in range(150)}
    filter_ = L.LanguageFilter.build(known, "l000")
    assert filter_.rows.shape[0] == 3
    for i, grams in enumerate(known.values()):
        assert ((filter_.masks(grams)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


def test_odd_rows(spark, documents, rows, none):
    got = L.identify(documents)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == len(rows)
    assert {r.lang_pred for r in got.collect()} == {"en", "und"}
    assert L.identify(none).count() == 0
    form = "doc_id long, text string, lang string, _text string, lang_pred string"
    unlabelled = spark.createDataFrame([(n, t, None, "own", "own") for n, t in enumerate(ODD)], form)
    assert {(r.lang_pred, r.score) for r in L.identify(unlabelled).collect()} == {("und", 0.0)}
    mixed = spark.createDataFrame([(n, t, "xx" if n % 2 else "yy", "own", "own") for n, t in enumerate(ODD * 3)], form)
    judged = {r.doc_id: r.lang_pred for r in L.identify(mixed).collect()}
    for n, t in enumerate(ODD * 3):
        assert (judged[n] == "und") == (not any(c.isalpha() for c in t or ""))


def test_the_sample_is_bounded(spark):
    form = "doc_id long, text string, lang string"
    made = spark.createDataFrame([(n, f"text {n}", "en") for n in range(3000)] + [(7, f"same {n}", "de") for n in range(2000)], form)
    counts = {r.lang: r["count"] for r in L.sample(made, 100).groupBy("lang").count().collect()}
    assert counts["en"] == 100 and counts.get("de", 0) <= 100
