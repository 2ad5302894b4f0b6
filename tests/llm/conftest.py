import random

import pytest

from millrace.llm.bpe import default_tokenizer

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars int, score string, _text string"


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, long, repeated, near copies, personal data, benchmark words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(1, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(5, 150))) for _ in range(40)]
    shared = " ".join(word() for _ in range(60))
    out = [None, "", " ", "\n\n", "a", "A  b", "x" * 300, "ab" * 4000, "1 " * 3000, "9" * 5000,
           "a." * 3000 + "@" + "b." * 3000, "\t\u00a0\u3000x y\u2028z", "<|endoftext|>", "it's <|endoftext|> we'll"]
    out += prose
    out += [prose[3], prose[3], prose[3] + " end", prose[4].upper(), prose[5] + "\n" + shared,
            shared + " " + prose[6], prose[7][:80] + shared + prose[8], shared, shared * 3,
            prose[9].replace(" ", "\n"), prose[10] + " \n " + prose[11]]
    out += [f"{prose[i][:90]} contact foobar mail to.x{i % 2}@ex-ample.co.uk foobar now {prose[i][90:200]}"
            for i in range(8)]
    out += [
        "a@b.c.d+e@f.gg.hh-@x.y ... @z a@b a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.04 1.2.3 1...4",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 12 4111111111111111-1",
        "+49 (30) 123-456.78 +1 2 +123456789012345678 +1-2-3-4-5-6-7-8-9-", "mail +a@b.cd +1 555 0100 999 é@ü.de",
        "1" * 13 + " " + "0" * 16 + "-" + "5 5-5 5 5 5 5 5 5 5 5 5 5 5", "\U0001F600" * 5 + " x@y.zz \U0001F600 10.0.0.1",
        shared[:200] + "\U0001F600 " + shared[100:]]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text), with shared ids, equal rows and null ids."""
    made = [(3 * i + 1, t) for i, t in enumerate(texts)]
    made += [(1, "first of all " + (texts[20] or "")), (made[25][0], texts[30]), made[22], made[22],
             (None, texts[21]), (None, None), (10_000_000_000, texts[24])]
    return made


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "src", len(t or ""), "own", "own") for i, t in rows], DOCUMENT).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def listed(frame, *columns):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)


def as_listed(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))
