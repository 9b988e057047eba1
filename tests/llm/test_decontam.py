import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import decontam


def brute(docs, items):
    """[(doc_id, n_words, hit places, item ids)] by comparing every window of every item at every place."""
    parsed = [(str(i) if i is not None else "", decontam.words_of((t or "").encode())) for i, t in items]
    out = []
    for doc, text in docs:
        words = decontam.words_of((text or "").encode())
        hit, found = set(), set()
        for item, w in parsed:
            n = min(10, len(w))
            windows = {tuple(w[a:a + n]) for a in range(len(w) - n + 1)} if n else set()
            for p in range(len(words) - n + 1):
                if tuple(words[p:p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(item)
        out.append((doc, len(words), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


def got(df):
    rows = df.withColumn("n", decontam.words_hit(F.col("hits"))).collect()
    out = []
    for r in rows:
        places = sorted({p for s in r["hits"] for p in range(s["start"], s["end"])})
        assert r["n"] == len(places)
        out.append((r["doc_id"], r["n_words"], tuple(places), tuple(r["items"])))
    return sorted(out, key=repr)


def fixture():
    rnd = random.Random(3)
    vocab = ["a", "bb", "Ünd", "c3", "dog", "x"]
    say = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([10, 12, 25]))) for i in range(12)]
    items += [(12, "dog"), (13, "a x c3"), (14, "bb bb"), (15, None), (16, " .,"), (None, say(11)), (3, say(10)), (17, items[0][1])]
    docs = [(i, say(rnd.randrange(0, 60))) for i in range(60)]
    for i in range(60, 110):
        _, t = rnd.choice(items)
        docs.append((i, say(rnd.randrange(5)) + " | " + (t or "").upper() + "!" + say(rnd.randrange(5))))
    long = "w" * (decontam.SLICE + 5)
    items.append((18, f"{long} one two three four five six seven eight nine ten"))
    docs += [(200, None), (201, ""), (202, "...\x00"), (None, items[1][1]), (203, items[2][1]), (203, items[2][1]),
             (204, f"{long} One two three four five six seven eight nine"), (205, f"{long}w one two three four five six seven eight nine"),
             (206, "zz " * 200_000 + items[4][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "v", 1) for i, t in docs], "doc_id long, text string, hits string, n_words int")
    b = spark.createDataFrame([(i, t, "v") for i, t in items], "item_id long, text string, k1 string")
    return d, b


def test_equals_brute_force(spark):
    docs, items = fixture()
    d, b = frames(spark, docs, items)
    assert got(decontam.contamination(d.repartition(5), b)) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = fixture()
    items = [x for x in items if x[0] != 18]        # one of its words alone is more than these blocks
    d, b = frames(spark, docs, items)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    assert len(list(decontam.item_blocks(b, "item_id", "text"))) > 4
    assert got(decontam.contamination(d.coalesce(2), b)) == brute(docs, items)


def test_long_item_in_overlapping_parts(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(391)]
    d, b = frames(spark, docs, [(1, text)])
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert all(len(r[2]) == 10 and r[3] == ("1",) for r in got(decontam.contamination(d.coalesce(2), b)))


@pytest.mark.parametrize("n_docs, n_items", [(0, 3), (3, 0), (0, 0)])
def test_empty_tables(spark, n_docs, n_items):
    docs, items = [(i, "one two three") for i in range(n_docs)], [(i, "two") for i in range(n_items)]
    assert got(decontam.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_common_passage_and_ties(spark):
    """A passage that every document holds, and windows that share all but one word."""
    base = [f"q{i}" for i in range(9)]
    items = [(i, " ".join([*base, f"end{i}"])) for i in range(300)]
    docs = [(i, " ".join(["pre", *base, f"end{i % 400}", "post"])) for i in range(800)]
    assert got(decontam.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = decontam.op11_decontamination(spark, sf)
    cur = con.execute(decontam.OP11_SQL)
    assert df.columns == [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in want}
