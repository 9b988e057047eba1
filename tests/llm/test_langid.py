import zlib
from collections import Counter

import numpy as np

from sitewatch.llm import langid


def test_counts_do_not_depend_on_the_cut(monkeypatch):
    text = "Ärger  und Öl, 12 -- été!\nx" * 9
    whole = langid.counts(text)
    for cut in (1, 2, 3, 5, 7, 64):
        monkeypatch.setattr(langid, "CUT", cut)
        assert (langid.counts(text) == whole).all(), cut
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    assert whole.sum() == sum(len(line) - n + 1 for n in (1, 2, 3))
    grams = Counter(line[i:i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    assert np.count_nonzero(whole) <= len(grams) and whole.max() >= max(grams.values())
    assert langid.counts(None) is langid.counts("") is langid.counts("12 ?! \n") is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op9_langid(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out]) > 0.97
    # calibrated: about as often right as it says
    assert abs(np.mean([r["score"] for r in out]) - np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out])) < 0.05


def test_elastic_net_leaves_zeros():
    rnd = np.random.default_rng(1)
    rows = [(rnd.permutation(langid.DIM)[:50], np.full(50, 0.1), int(rnd.integers(2))) for _ in range(50)]
    assert (langid.ftrl(rows, 2, l1=0.5) == 0).mean() > 0.9


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, Score string, h string"
    rows = [(i, t, l, "s", None) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (None, "12 34", "de", None, None), (102, "the dog " * 40000, None, None, None),
             (0, "the cat and the dog", "en", "s", None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    model = langid.train(df)
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, None, 102, 0, 1)] == ["und", "und", "und", "en", "en", "de"]
    assert got[100]["score"] == 0 and set(got[0].asDict()) == {"doc_id", "text", "lang", "h", "lang_pred", "score"}
    none = spark.createDataFrame([], schema)
    assert langid.predict(df, langid.train(none)).select("lang_pred").distinct().collect() == [("und",)]
    assert langid.predict(none, model).collect() == []


def test_only_allowed_rows_teach(spark):
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    skip = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    rows = [(i, "the cat and", "en") for i in learn[:20]] + [(i, "der hund und", "de") for i in learn[20:]] + [(i, "xx yy zz", "xx") for i in skip]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["de", "en"]


def test_every_language_is_learned(spark, monkeypatch):
    """Many languages with as many rows each: none is left out, the rows a language become fewer."""
    names = [f"l{i:03d}" for i in range(104)]
    word = {l: chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i, l in enumerate(names)}
    learn = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(d, word[l] * 3, l) for d, l in zip(learn, names * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    real = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda rows, classes: seen.append(len(rows)) or real(rows, classes))
    model = langid.train(df)
    assert model.langs == names
    assert [model.predict(word[l])[0] for l in names] == names
    monkeypatch.setattr(langid, "MOST_ROWS", 208)
    monkeypatch.setattr(langid, "FEWEST", 1)
    assert langid.train(df).langs == names and seen[1] <= 208 < seen[0]
