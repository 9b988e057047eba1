"""Exact top-k search by distributed histogram selection (operator 7).

For a block of queries every task scores all its rows and counts the scores in
a histogram over the interval that still holds the query's k-th score.  The
summed histograms narrow the interval, again and again, until few scores remain
at or above its lower end; then one pass filters the scores by that value and
breaks ties by the smaller id.  A task reports, from the top, only as many bins
as its own k best scores fill (the k-th score of all rows is never below that of
a part), and in the last pass its own k best rows.

Which rows take part and what repeated rows mean is told in ``vectors``.
Components are whole numbers; a score that no long holds is held at the last one that does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import best_of, gather_blocks, mapped, own_rows, query_blocks, shards, usable

BINS = 256
LONGS = -2 ** 63, 2 ** 63 - 1
SIGN = np.uint64(1 << 63)


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products (query x row) of vectors with whole components."""
    top = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1])
    if top < 2 ** 53:       # every partial sum is exact in a double
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], dtype=object) @ \
        np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.clip(exact, *LONGS).astype(np.int64)


def places(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order: intervals of them never overflow."""
    return scores.view(np.uint64) ^ SIGN


def at_places(places: np.ndarray) -> np.ndarray:
    return (places ^ SIGN).view(np.int64)


def _count(rows, dim, state):
    """Per query and bin the number of scores, down to the bin that holds the task's k-th."""
    qids, queries, lo, last, width, need = state
    n = len(qids)
    counts = np.zeros((n, BINS), dtype=np.int64)
    step = max(1, (1 << 21) // max(1, n))
    for ids, vecs in shards(rows, dim):
        for i in range(0, len(ids), step):
            s = places(scores(vecs[i:i + step], queries))
            ok = (s >= lo[:, None]) & (s <= last[:, None])      # what lies above the interval is counted already
            ok[own_rows(ids[i:i + step], qids)] = False
            at = ((s - lo[:, None]) // width[:, None]).astype(np.int64)
            flat = (np.arange(n)[:, None] * BINS + at)[ok]
            counts += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (above < need[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)),
                                      pa.array(counts[q, b])], names=["q", "bin", "n"])


def _filter(rows, dim, state, k):
    """A task's k best rows of each query among the scores at or above the found value."""
    qids, queries, least = state
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = max(1, (1 << 21) // max(1, len(qids)))
    for ids, vecs in shards(rows, dim):
        for i in range(0, len(ids), step):
            part = ids[i:i + step]
            s = scores(vecs[i:i + step], queries)
            ok = s >= least[:, None]
            ok[own_rows(part, qids)] = False
            for q in np.flatnonzero(ok.any(axis=1)).tolist():
                r = np.flatnonzero(ok[q])
                sq, iq = s[q, r], part[r]
                if q in best:
                    sq, iq = np.append(best[q][0], sq), np.append(best[q][1], iq)
                keep = np.lexsort((iq, -sq))[:k]
                best[q] = sq[keep], iq[keep]
    q = np.repeat(np.array(list(best), dtype=np.int32), [len(x[0]) for x in best.values()])
    cols = [np.concatenate([x[j] for x in best.values()]) if best else np.zeros(0, np.int64) for j in (1, 0)]
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cols[0]), pa.array(cols[1])], names=["q", "id", "score"])


def _block(spark: SparkSession, rows: DataFrame, dim: int, qids: np.ndarray, queries: np.ndarray,
           bound: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of one block; the driver holds three numbers a query."""
    sc, n = spark.sparkContext, len(qids)
    rows = rows.where(F.col("dim") == dim).select("id", "v")
    bound = min(bound, LONGS[1])
    lo = places(np.full(n, -bound if bound < LONGS[1] else LONGS[0], dtype=np.int64))
    last = places(np.full(n, bound, dtype=np.int64))
    width = (last - lo) // np.uint64(BINS) + np.uint64(1)
    need = np.full(n, k, dtype=np.int64)
    least, going = lo.copy(), np.ones(n, dtype=bool)
    while going.any():
        g = np.flatnonzero(going)
        state = sc.broadcast((qids[g], queries[g], lo[g], last[g], width[g], need[g]))
        parts = mapped(rows, lambda it, s=state: _count(it, dim, s.value), "q int, bin int, n long")
        summed = parts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        wanted = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(need[g])], "q int, need long")
        hit = (summed.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(wanted), "q")  # a row for each query of the block
               .where(F.col("upto") >= F.col("need"))
               .groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("h")).select("q", "h.*").collect())
        still = np.zeros(n, dtype=bool)
        for r in hit:       # a query without a row here has fewer than k candidates: all of them are its answer
            i = g[r["q"]]
            least[i] = lo[i] + np.uint64(r["bin"]) * width[i]
            left = need[i] - (r["upto"] - r["n"])
            if width[i] > 1 and r["n"] > left + 4 * k:
                lo[i], last[i], need[i], still[i] = least[i], min(int(last[i]), int(least[i]) + int(width[i]) - 1), left, True
                width[i] = (int(width[i]) + BINS - 1) // BINS
        state.unpersist()
        going = still
    state = sc.broadcast((qids, queries, at_places(least)))
    found = mapped(rows, lambda it: _filter(it, dim, state.value, k), "q int, id long, score long")
    ids = spark.createDataFrame([(i, int(x)) for i, x in enumerate(qids)], "q int, query_id long")
    return (best_of(found, k, F.desc("score")).join(F.broadcast(ids), "q")      # a row for each query of the block
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def exact_topk(df: DataFrame, is_query, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """For each query row (``is_query``, on the column ``id``) the k rows of highest inner product."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    schema = "query_id long, rank int, vec_id long, score long"

    def blocks() -> Iterator[DataFrame]:
        tops = None
        for dim, qids, queries in query_blocks(rows.where(is_query)):
            if tops is None:
                tops = {r["dim"]: r["top"] for r in rows.groupBy("dim").agg(
                    F.max(F.array_max(F.transform("v", F.abs))).alias("top")).collect()}
            bound = int(tops[dim] or 0) * int(np.abs(queries).max(initial=0)) * max(1, dim)
            yield _block(spark, rows, dim, qids, queries, bound, k)

    return gather_blocks(spark, blocks(), schema, "topk")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: 256 * x)
    # a double of 2^53 or more is whole; floor() would hold it within a long
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    # floor() turns what is not finite into a number: such vectors must go by their first components
    whole = F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), floors)
    return exact_topk(df.select("vec_id", whole.alias("whole")), F.col("id") % 50 == 0, 5, vector="whole")
