"""What the two vector searches share: which rows take part, and blocks of queries.

Rows without an id, and vectors that are null or hold null or non-finite
components, take no part.  A vector meets only vectors of its own length.
Repeated rows are candidates each; a repeated query row is asked once.  Rows
that share a query's id are the query's own and never its candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize, scratch_table_path

BLOCK_BYTES = 4 << 20      # of query vectors sent to the tasks together
BLOCK_ROWS = 4096
SHARD_BYTES = 32 << 20     # of vectors that a task holds together


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id long, v array<double>, dim int) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return (df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()
                   & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .withColumn("dim", F.size("v")))


def query_blocks(queries: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of all queries in order of (dim, id), a bounded number at a time."""
    every = rest = materialize(queries.dropDuplicates(), "queries")
    while True:
        first = rest.select("dim", "id").orderBy("dim", "id").limit(1).collect()
        if not first:
            return
        dim = first[0]["dim"]
        n = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
        rows = rest.where(F.col("dim") == dim).orderBy("id", "v").limit(n).collect()
        yield dim, np.array([r["id"] for r in rows], dtype=np.int64), _matrix([r["v"] for r in rows], dim)
        last = rows[-1]
        rest = every.where((F.col("dim") > dim) | (F.col("dim") == dim) & (
            (F.col("id") > last["id"]) | (F.col("id") == last["id"]) & (F.col("v") > F.lit(list(last["v"])).cast("array<double>"))))


def _matrix(rows: list[list[float]], dim: int) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), dim)


def shards(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a task's rows, gathered up to a bounded size; columns id and v."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy())
        rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim))
        size += batch.num_rows * max(1, dim) * 8
        if size >= SHARD_BYTES:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def own_rows(ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) at which a row is the query's own."""
    rows = np.flatnonzero(np.isin(ids, queries))
    q, r = np.nonzero(queries[:, None] == ids[rows][None, :])
    return q, rows[r]


def best_of(found: DataFrame, k: int, score_order) -> DataFrame:
    """The k best rows of each query: (q, id, score) -> with rank, ties to the smaller id."""
    from pyspark.sql import Window
    w = Window.partitionBy("q").orderBy(score_order, "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gather_blocks(spark: SparkSession, blocks: Iterator[DataFrame], schema: str, name: str) -> DataFrame:
    """The blocks' results, each written to the shared scratch folder once it is found."""
    path = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex}")
    n = 0
    for n, block in enumerate(blocks, 1):
        block.write.parquet(f"{path}/block={n}")
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/block={i + 1}" for i in range(n)))


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    from .common import in_arrow
    return in_arrow(df, fn, schema)
