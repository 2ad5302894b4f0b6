"""The pipeline's stages against plain versions of them."""

import random

import corpus_pipeline as P
import pytest
from brute import contaminated, linked, personal
from conftest import as_listed, listed


@pytest.fixture(scope="module")
def folder(spark, documents, rows, texts, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, texts[20]), (2, "foobar now")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_near_duplicates(spark, documents, rows, folder):
    got = P.drop_near_duplicates(spark, documents, folder)
    assert got.columns == documents.columns
    left = listed(got, "doc_id", "text")
    root = {row: r for row, (_, r) in zip(rows, linked(rows))}
    # One row of each component, whether its rows have ids or not: the one with the smallest.
    assert sorted(root[row] for row in left) == sorted(set(root.values()))
    for row in left:
        ids = [i for (i, t), r in root.items() if r == root[row] and i is not None]
        assert row[0] == (min(ids) if ids else None)


def test_texts_without_an_id_or_with_a_shared_one_stay(spark, folder):
    text = lambda n: " ".join(f"word{n}x{i}" for i in range(40))
    made = [(None, text(n)) for n in range(4)] + [(7, text(n)) for n in range(10, 13)]
    frame = spark.createDataFrame(made + made[:1] + made[-1:], "doc_id long, text string")
    assert listed(P.drop_near_duplicates(spark, frame, folder), "doc_id", "text") == as_listed(made)


CLASHING = ["_row", "_copy", "_score", "_id", "_k", "_spans", "_key", "_fp", "_root", "_ROW_"]


def test_columns_of_any_name_are_carried_along(spark, rows, folder):
    form = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    frame = spark.createDataFrame([(*r, *[f"own {c}" for c in CLASHING]) for r in rows[10:40]], form)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, frame, folder)
        assert got.columns == frame.columns, name
        found = got.collect()
        assert found, name
        assert all(r[c] == f"own {c}" for r in found for c in CLASHING), name
    assert P.encode(spark, frame, folder).count() == 30


def test_decontamination(spark, documents, rows, texts, folder):
    got = listed(P.drop_contaminated(spark, documents, folder), "doc_id", "text")
    items = [(1, texts[20]), (2, "foobar now")]
    assert got == as_listed([r for r, c in zip(rows, contaminated(rows, items)) if not c[-1]])


def test_toxicity_keeps_columns_and_clean_rows(spark, documents, rows, folder):
    got = P.drop_toxic(spark, documents, folder)
    assert got.columns == documents.columns
    assert got.count() == len(rows)


def test_personal_data(spark, documents, rows, folder):
    got = P.sanitise(spark, documents, folder)
    assert got.columns == documents.columns and got.count() == len(rows)
    assert all(not personal(r.text) or "[" in r.text for r in got.collect())


def test_a_toxic_text_goes_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioubdglmnrst", k=rng.randint(2, 7)))
    made = []
    for n in range(1200):
        words = [word() for _ in range(rng.randint(20, 90))]
        if n % 8 == 0:
            words[5] = words[15] = rng.choice(["blargword", "frunkish", "zortling"])
        made.append((n, " ".join(words), int(n % 8 == 0)))
    spark.createDataFrame([(n, y) for n, _, y in made], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(n, t) for n, t, _ in made], "doc_id long, text string")
    left = {r.doc_id for r in P.drop_toxic(spark, docs, str(tmp_path)).collect()}
    toxic = {n for n, _, y in made if y}
    assert len(toxic - left) > 0.95 * len(toxic)
    assert len(left - toxic) > 0.97 * (len(made) - len(toxic))


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_empty(spark, none, folder):
    for name, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_tokens_and_decoded_texts_are_kept(spark, documents, rows, tokenizer):
    got = P.tokens(documents)
    assert set(documents.columns) - {"text"} < set(got.columns)
    found = listed(got, "doc_id", "decoded", "ids", "n_tokens")
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        want.append((i, tokenizer.decode(ids, skip_special_tokens=False), packed, len(ids)))
    assert [(i, d, bytes(p), n) for i, d, p, n in found] == as_listed(want)


def test_words_between_other_white_space_come_from_the_table(tokenizer):
    from millrace.llm import bpe

    head = {w: b"\1\0\0\0" for w in ("known", "word")}  # ids that only the table has
    codec = bpe.WordCodec(bpe.default_tokenizer(), head)
    got = bytes(codec._encode_odd("a\t known known word known").tobytes())
    assert got.count(b"\1\0\0\0") == 3
