"""Every stage against a brute-force version, each on what the stage before it kept."""

import corpus_pipeline
import numpy as np
import pytest
from sitewatch.llm import langid, pii
from test_linededup import brute as removed_lines
from test_packing import PATH, check
from test_simhash import groups, plain
from tokenizers import Tokenizer


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before the first stage and behind each."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", None, None, None), (10 ** 6 + 2, "12 !", "en", "s", 4)], docs.schema)
    docs = docs.unionByName(extra)
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], sf).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return out


def test_columns(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[:-1])


def test_language(stages):
    model = langid.train(stages[0])
    want = [r for r in rows(stages[0]) if (p := model.predict(r[1]))[0] != "und" and p[1] >= corpus_pipeline.MIN_SCORE]
    assert sorted(rows(stages[1])) == sorted(want) and len(want) >= 0.97 * (stages[0].count() - 3)


def test_lines(stages):
    before = rows(stages[1])
    after = {(d, t) for d, t, _ in removed_lines([r[:2] for r in before])}
    assert {r[:2] for r in rows(stages[2])} == after and all(r[4] == len(r[1]) for r in rows(stages[2]))


def test_near_duplicates(stages):
    docs = sorted(rows(stages[2]))
    label = groups([plain(r[1]) for r in docs])
    assert sorted(rows(stages[3])) == [r for r, l, i in zip(docs, label, range(len(docs))) if l == i]


def test_personal_data(stages):
    before = {r[0]: r for r in rows(stages[3])}
    after = {r[0]: r for r in rows(stages[4])}
    real = {c for r in before.values() for *_, c in pii.detect(r[1])}
    assert set(before) == set(after) and real
    for d, r in after.items():
        assert not real & {c for *_, c in pii.detect(r[1])}
        assert r[1] == before[d][1] or pii.detect(before[d][1])


def test_packing(stages, spark, sf):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = {r[0]: r[1] for r in rows(stages[4])}
    assert check(stages[5].collect(), texts, lambda x: t.encode(x, add_special_tokens=False).ids + [0]) < 1.05


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    text = "some words that are long enough to tell what they are. " * 5
    odd = [(None, None, None, None, None), (None, text, "en", None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, "", "en", "s", 0)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert np.unique([r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect() if r["doc_id"]]).tolist() == [1]


def test_without_a_language_texts_stay(spark):
    given = [(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "слова 日本", None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    assert sorted(rows(corpus_pipeline.identify_language(spark, docs, ""))) == [given[0], given[3]]
