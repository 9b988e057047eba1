"""Columns named like the operators' helpers pass through, or give way where they are named as an output."""

import pytest
from sitewatch.llm import bpe, langid, quality, simhash

NAMES = ["__text", "text_", "ids_", "__ids", "__i", "__a", "__b", "__id", "__h1", "row_id", "kept_h1", "fp", "key", "root", "at"]
ROWS = [(i, "some words of a text that is long enough", *[f"{n}{i}" for n in NAMES]) for i in (1, 2)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, ["doc_id", "text", *NAMES])


def kept(rows):
    return sorted(tuple(r)[:len(NAMES) + 2] for r in rows)


def test_quality(df):
    docs = df.sparkSession.createDataFrame([(i, "ab" * 50 if i % 2 else "zq " * 40) for i in range(60)], "doc_id long, text string")
    labels = df.sparkSession.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert kept(quality.score(df, quality.train(docs, labels)).collect()) == ROWS


def test_langid(df):
    docs = df.sparkSession.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(60)],
                                           "doc_id long, text string, lang string")
    assert kept(langid.predict(df, langid.train(docs)).collect()) == ROWS


def test_simhash(df):
    assert kept(simhash.keep_one(df).collect()) == ROWS[:1]


def test_bpe(df):
    import public_tokenizers as P
    path = P.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert kept(done) == ROWS and all(bytes(r["decoded"]).decode() == r["text"] for r in done)
