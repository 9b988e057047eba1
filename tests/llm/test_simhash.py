import random
import re

import numpy as np
import pytest
import xxhash

from sitewatch.llm import simhash


def plain(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, distance=4):
    """Component labels by comparing everything."""
    fps = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= distance) for f in fps]
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    rnd = random.Random(1)
    texts = ["", None, " \n\t", "One", "ÀB c", "a b c d", "A B\x0bc\x0cd e", "x\x85y z w v", "x\x1cy z w v",
             "w " * 50000]
    texts += [" ".join(rnd.choice("ab cd É Z 1".split()) for _ in range(rnd.randrange(1, 30))) for _ in range(60)]
    assert simhash.fingerprints(texts).tolist() == [plain(t) for t in texts]


def some_fingerprints(rnd, n, centres, flips):
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(n // centres):
            f = c
            for _ in range(rnd.randrange(flips + 1)):
                f ^= 1 << rnd.randrange(64)
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("centres, flips, distance", [(300, 6, 4), (5, 8, 4), (1, 12, 4), (40, 3, 1), (900, 0, 4), (2, 3, 0)])
def test_trie_equals_brute_force(centres, flips, distance):
    fps = np.array(some_fingerprints(random.Random(centres), 1200, centres, flips), dtype=np.uint64)
    got = simhash.trie_components(fps, np.array([[0, len(fps), 0, len(fps)]]), distance)
    assert got.tolist() == groups(fps, distance).tolist()
    half = len(fps) // 2
    got = simhash.trie_components(fps, np.array([[0, half, 0, half], [half, len(fps), half, len(fps)], [0, half, half, len(fps)]]), distance)
    assert got.tolist() == groups(fps, distance).tolist()


def frame(spark, fps):
    return spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")


@pytest.mark.parametrize("part", [simhash.PART, 50])
def test_classes_with_split_tries(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "TASK_ROWS", 300)
    fps = some_fingerprints(random.Random(9), 900, 3, 7) + some_fingerprints(random.Random(10), 300, 100, 5)
    rows = simhash.classes(frame(spark, fps + fps[:50]).repartition(3)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["root"], set()).add(r["fp"] % 2 ** 64)
    want = {}
    for f, l in zip(fps, groups(fps)):
        want.setdefault(l, set()).add(f)
    assert len(rows) == len(set(fps)) and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_query(spark, sf):
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    label = groups([f for _, f in docs])
    least = {l: min(d for (d, _), m in zip(docs, label) if m == l) for l in set(label)}
    want = {(d, f"{f:016x}", least[l]) for (d, f), l in zip(docs, label)}
    got = simhash.op8_simhash(spark, sf).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, Fp string, u int"
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text.replace("word7 ", "WORD7 ")), (None, None), (8, ""), (7, " "), (1, "x " * 70000),
            (5, "another text")]
    df = spark.createDataFrame([(a, b, "k", None) for a, b in rows], schema).repartition(3)
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} >= {(5, 3), (3, 3), (9, 3), (None, 7), (8, 7), (7, 7), (1, 1), (5, 5)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"][:3]) for r in kept.collect()) == [(1, "x x"), (3, "wor"), (5, "ano"), (7, " ")]
    none = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []
