import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import ann, topk

ODD = [(1000, None), (1100, []), (1200, [float("nan"), 1.0]), (1300, [float("inf"), 1.0]), (1400, [None, 1.0]),
       (None, [1.0, 2.0]), (1500, [0.0, 0.0]), (1600, [1.0, 2.0, 3.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", None) for i, v in rows], "vec_id long, embedding array<float>, Rank string, score int")


def usable(rows, zero):
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute(rows, every, k, distance):
    rows = usable(rows, not distance)
    out = set()
    for qi, q in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        q = np.array(q)
        if distance:
            s = [(math.sqrt(((v - q) ** 2).sum()), i) for i, v in rows if i != qi and len(v) == len(q)]
        else:
            s = [(-int(np.floor(256 * v).astype(object) @ np.floor(256 * q).astype(object)) if len(v) else 0, i)
                 for i, v in rows if i != qi and len(v) == len(q)]
        for rank, (d, i) in enumerate(sorted(s)[:k], 1):
            out.add((qi, rank, i, round(d, 9) if distance else -d))
    return out


def fixture(n, dim):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.standard_normal(dim).astype(np.float32)]) for i in range(n)]
    rows += [(5000 + i, rows[3][1]) for i in range(60)]       # copies: ties
    rows += rows[:4] + [(0, rows[9][1])]                      # repeated rows, one id with two vectors
    return rows + ODD


def test_topk_equals_brute_force(spark):
    rows = fixture(400, 2)
    df = frame(spark, rows).repartition(5)
    whole = df.select("vec_id", F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
                      F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))).alias("w"))
    got = topk.exact_topk(whole, F.col("id") % 50 == 0, 5, vector="w").collect()
    assert {tuple(r) for r in got} == brute(rows, 50, 5, False)


def test_topk_narrows_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "BINS", 7)
    rnd = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rnd.standard_normal(3).astype(np.float32)]) for i in range(3000)]
    df = frame(spark, rows).repartition(3)
    whole = df.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double")).alias("w"))
    got = topk.exact_topk(whole, F.col("id") % 50 == 0, 5, vector="w").collect()
    assert {tuple(r) for r in got} == brute(rows, 50, 5, False)


def test_topk_few_rows_large_values_and_none(spark):
    df = frame(spark, [(0, [1e30, 0.0]), (50, [1e30, -1e30]), (7, [-1e30, 3.0])])
    got = topk.exact_topk(df, F.col("id") % 50 == 0, 5, vector="embedding").collect()
    low, high = topk.LONGS          # beyond what a long holds
    assert {tuple(r) for r in got} == {(0, 1, 50, high), (0, 2, 7, low), (50, 1, 0, high), (50, 2, 7, low)}
    assert topk.exact_topk(frame(spark, []), F.col("id") % 50 == 0, 5, vector="embedding").collect() == []


def test_topk_over_all_longs(spark):
    """Scores between 2^61 and 2^63 either way, with ties."""
    rnd = np.random.default_rng(8)
    rows = [(i, [float(a) * 2 ** 29, float(b) * 2 ** 28]) for i, (a, b) in enumerate(rnd.integers(-5, 6, (500, 2)).tolist())]
    got = topk.exact_topk(frame(spark, rows).repartition(4), F.col("id") % 50 == 0, 5, vector="embedding").collect()
    want = set()
    for i, q in rows[::50]:
        s = sorted((-sum(int(x) * int(y) for x, y in zip(q, v)), j) for j, v in rows if j != i)
        want |= {(i, rank, j, -d) for rank, (d, j) in enumerate(s[:5], 1)}
    assert {tuple(r) for r in got} == want and max(abs(w[3]) for w in want) > 2 ** 62


def test_topk_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = topk.op7_topk(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 50, 5, False)


def test_ann_visiting_all_equals_brute_force(spark):
    rows = fixture(300, 2)
    got = ann.nearest(frame(spark, rows).repartition(4), F.col("id") % 100 == 0, 10, goal=1.0).collect()
    assert {(a, b, c, round(d, 9)) for a, b, c, d in got} == brute(rows, 100, 10, True)
    assert ann.nearest(frame(spark, []), F.col("id") % 100 == 0, 10).collect() == []


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_ann_recall(spark, name):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").collect()]
    got = ann.op6_ann(spark, f"/root/testdata/{name}").collect()
    true = brute(rows, 100, 10, True)
    assert len(got) == len(true)
    found = {(r["query_id"], r["vec_id"], round(r["score"], 9)) for r in got}
    want = {(a, c, d) for a, _, c, d in true}
    assert len(found & want) >= 0.9 * len(want)


def test_several_blocks_of_queries(spark, monkeypatch):
    from sitewatch.llm import vectors
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    rows = fixture(200, 2)[:-len(ODD)] + [(100, [1.0, 2.0, 3.0]), (150, [0.5, 2.0, 1.0])]
    df = frame(spark, rows).repartition(3)
    got = ann.nearest(df, F.col("id") % 50 == 0, 10, goal=1.0).collect()
    assert {(a, b, c, round(d, 9)) for a, b, c, d in got} == brute(rows, 50, 10, True)
