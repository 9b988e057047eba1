import zlib

import numpy as np
import pytest

from sitewatch.llm import quality


def test_chunks_cover_every_window():
    for n in (0, 1, 7, 8, 505, 506, 507, 511, 512, 513, 514, 1018, 1019, 5000):
        data = bytes((i * 7 + 1) % 255 + 1 for i in range(n))
        windows = {x[i:i + quality.WIDTH].tobytes() for x in quality.chunks(data) for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)}
        padded = data + bytes(quality.STRIDE)
        for i in range(0, max(0, n - quality.WIDTH + 1), quality.STRIDE):
            assert padded[i:i + quality.WIDTH] in windows, (n, i)


def test_scores_do_not_depend_on_grouping(monkeypatch):
    net = quality.Network.fresh()
    texts = ["", None, "a", "long text " * 3000, "x" * 600, "é" * 300]
    whole = net.scores(texts)
    monkeypatch.setattr(quality, "TOGETHER", 3)
    assert np.allclose(net.scores(texts), whole, atol=1e-6) and np.allclose([net.scores([t])[0] for t in texts], whole, atol=1e-6)
    assert ((0 <= whole) & (whole <= 1)).all() and whole[0] == whole[1]


def test_gradients_lower_the_loss():
    rnd = np.random.default_rng(0)
    rows = [(bytes(rnd.integers(97, 110, 300)), 1) for _ in range(60)] + [(bytes(rnd.integers(97, 110, 200)) + b"$$##$$" * 9, 0) for _ in range(20)]
    s = quality.fit(rows).scores([d.decode() for d, _ in rows])
    assert s[:60].min() > 0.5 > s[60:].max()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    rows = {r["doc_id"]: r for r in quality.op2_quality(spark, sf).collect()}
    assert sorted(rows) == sorted(docs)
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]}
    got = np.array([rows[d]["predicted"] for d in known])
    assert (got == np.array(list(known.values()))).mean() > 0.96


def test_odd_rows(spark):
    rows = [(i, "clean words here and there " * (1 + i % 9) if i % 2 else "$$$ ### $$$ &&& " * (1 + i % 9), None) for i in range(400)]
    rows += [(None, None, "x"), (1000, "", None), (1001, "word " * 60000, None), (1, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(400)] + [(None, 1, "z"), (1000, None, "z"), (5, 1, "z")],
                                   "doc_id long, quality int, text string")
    net = quality.train(df, labels)
    got = quality.score(df, net)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(rows)
    s = {r["doc_id"]: r["score"] for r in got.collect()}
    assert np.mean([s[i] > 0.5 for i in range(1, 400, 2)]) > 0.95 and np.mean([s[i] < 0.5 for i in range(0, 400, 2)]) > 0.95
    assert s[None] == s[1000]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert {r["score"] for r in quality.score(df, quality.train(none, labels)).collect()} == {0.5}
    assert quality.score(none, net).collect() == []


def test_echoes():
    x = quality.chunks(b"ab ab ab xy " + bytes(range(97, 122)))[:1]
    data = x[0].tobytes()
    want = [any(i - 3 - lag >= 0 and data[i - 3:i + 1] == data[i - 3 - lag:i + 1 - lag] and 0 not in data[i - 3:i + 1] for lag in quality.LAGS)
            for i in range(len(data))]
    assert quality.echoes(x)[0].tolist() == want and any(want)
