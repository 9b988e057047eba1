"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 6).

``TABLES`` hash tables of ``HASHES`` functions floor((a.x + b) / w), a Gaussian.
Every row is in every table; the index is held in shards, one for each part of a
task's rows, so no vector is shuffled.  A block of queries goes to all shards.
There the perturbed buckets (the occupied ones, at any slot distance from the
query's own) are visited in order of their estimated success: the probability
that a neighbour at radius r lies in that bucket, which for each function is a
normal integral over the slot, seen from the query's place in its own slot.
Visiting ends at the success below which, in ``DRAWS`` simulated neighbours at
that radius, only so few buckets lie that the tables together hold a neighbour
with probability ``goal``; and not before k candidates are found or the shard is
spent.  The
tables' candidates are merged and ranked anew by exact distance; a shard reports
its k best.

Only the radius (and with it the slot width w) is fitted, on ``SAMPLE_ROWS``
rows of smallest id hash: the distance of the k-th neighbour, taken at the rank
that k has in a sample of that size and therefore rather too large than too
small.  Which rows take part and what repeated rows mean is told in ``vectors``;
zero vectors take no part here.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import _matrix, best_of, gather_blocks, mapped, own_rows, query_blocks, shards, usable

TABLES, HASHES, SLOT, GOAL, SAMPLE_ROWS, DRAWS, SEED = 6, 8, 1.5, 0.97, 2000, 400, 7


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Of the standard normal, within 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-np.minimum(x * x / 2, 700)) / np.sqrt(2 * np.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


def _log_success(slots: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log of the chance that a neighbour at the radius falls into a slot, seen from ``place`` (in slots)."""
    low = (slots - place) * SLOT
    return np.log(np.maximum(normal_cdf(low + SLOT) - normal_cdf(low), 1e-30))


def fit(rows: DataFrame, dim: int, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(radius, directions, offsets as shares of a slot) for the vectors of one length."""
    rows = rows.where(F.col("dim") == dim)
    n = rows.count()
    # at most SAMPLE_ROWS vectors come to the driver
    got = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).select("v").collect()
    x = _matrix([r["v"] for r in got], dim)
    at = min(len(x) - 1, max(1, ceil(k * len(x) / max(1, n))))
    near = []
    for q in x[:200]:
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        near.append(np.partition(d, at)[at] if at > 0 else 0.0)
    radius = float(np.percentile(near, 90)) if near else 0.0
    rnd = np.random.default_rng(SEED)
    return radius or 1.0, rnd.standard_normal((TABLES * HASHES, dim)), rnd.random(TABLES * HASHES)


def _search(batches, dim, state, k, goal):
    qids, queries, radius, directions, offsets = state
    w = SLOT * radius
    per_table = 1 - (1 - goal) ** (1 / TABLES) if goal < 1 else 1.0
    place = queries @ directions.T / w + offsets
    draws = np.random.default_rng(SEED).standard_normal((DRAWS, TABLES * HASHES)) / SLOT
    log_success = np.array([_log_success(np.floor(p + draws), p) for p in place])
    log_success = log_success.reshape(len(qids), DRAWS, TABLES, HASHES).sum(axis=3)
    least = np.quantile(log_success, 1 - per_table, axis=1) if goal < 1 else np.full((len(qids), TABLES), -np.inf)
    for ids, vecs in shards(batches, dim):
        codes = np.floor(vecs @ directions.T / w + offsets)
        own = {}
        for q, r in zip(*own_rows(ids, qids)):
            own.setdefault(int(q), []).append(int(r))
        buckets = []            # per table: code of each bucket as slot numbers, bucket of each row, rows a bucket
        for t in range(TABLES):
            c = codes[:, t * HASHES:(t + 1) * HASHES]
            uniq, of_row, size = np.unique(c, axis=0, return_inverse=True, return_counts=True)
            slots = [np.unique(uniq[:, i], return_inverse=True) for i in range(HASHES)]
            buckets.append((slots, of_row.reshape(-1), size))
        out_q, out_id, out_d = [], [], []
        for q in range(len(qids)):
            seen = np.zeros(len(ids), dtype=bool)
            for t, (slots, of_row, size) in enumerate(buckets):
                score = 0.0
                for i, (values, number) in enumerate(slots):
                    score = score + _log_success(values, place[q, t * HASHES + i])[number]
                order = np.argsort(-score, kind="stable")
                upto = max(np.searchsorted(-score[order], -least[q, t], side="right"),
                           np.searchsorted(np.cumsum(size[order]), k + len(own.get(q, ()))) + 1)
                visited = np.zeros(len(size), dtype=bool)
                visited[order[:upto]] = True
                seen |= visited[of_row]
            seen[own.get(q, [])] = False
            cand = np.flatnonzero(seen)
            if not len(cand):
                continue
            d = np.sqrt(((vecs[cand] - queries[q]) ** 2).sum(axis=1))
            if len(cand) > k:
                close = d <= np.partition(d, k - 1)[k - 1]
                cand, d = cand[close], d[close]
            best = np.lexsort((ids[cand], d))[:k]
            out_q.append(np.full(len(best), q, dtype=np.int32))
            out_id.append(ids[cand[best]])
            out_d.append(d[best])
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_id, out_d)],
                                             names=["q", "id", "score"])


def nearest(df: DataFrame, is_query, k: int, vec_id: str = "vec_id", vector: str = "embedding",
            goal: float = GOAL) -> DataFrame:
    """For each query row (``is_query``, on the column ``id``) its k nearest rows found."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector).where(F.exists("v", lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"

    def blocks() -> Iterator[DataFrame]:
        fitted = (None, None)
        for dim, qids, queries in query_blocks(rows.where(is_query)):
            if fitted[0] != dim:
                fitted = dim, fit(rows, dim, k)
            state = spark.sparkContext.broadcast((qids, queries, *fitted[1]))
            found = mapped(rows.where(F.col("dim") == dim).select("id", "v"),
                           lambda it, s=state, d=dim: _search(it, d, s.value, k, goal), "q int, id long, score double")
            ids = spark.createDataFrame([(i, int(x)) for i, x in enumerate(qids)], "q int, query_id long")
            yield (best_of(found, k, F.col("score")).join(F.broadcast(ids), "q")    # a row for each query of the block
                   .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))

    return gather_blocks(spark, blocks(), schema, "ann")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, 10)
