"""Vectors of whole numbers, for the operators whose contracts scale and floor components.

A row takes part if its vector is not null and every component is a finite number of
less than 2^53 in size after scaling (beyond that a double tells whole numbers apart no
longer).  Vectors of different lengths are different spaces: each length is worked on
by itself.  Repeated rows count as often as they occur; a null id is an id of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.session import materialize

LIMIT = float(1 << 53)


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int, label: str | None = None) -> DataFrame:
    """(id, v array<long>, dim int, label) with v = floor(scale * vector), written once: every pass reads it."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), v.alias("x"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scale * c) < LIMIT)))
    return materialize(rows.select("id", F.transform("x", lambda c: F.floor(scale * c)).alias("v"), F.size("x").alias("dim"), "label"), "whole")


def lengths(rows: DataFrame) -> list[int]:
    return sorted(r["dim"] for r in rows.select("dim").distinct().collect())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def exact(a: np.ndarray, bound: int) -> np.ndarray:
    """``a`` for arithmetic whose results stay within ``bound``: in 64 bits where those suffice, in Python's integers elsewhere."""
    return a if bound < 1 << 62 else a.astype(object)


def size(a: np.ndarray) -> int:
    """The largest magnitude."""
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def as_longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as a column; null where a long cannot hold one."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if abs(int(x)) < 1 << 63 else None for x in values], pa.int64())


def sums_of(parts: DataFrame, keys: list[str], columns: list[str]) -> Iterator:
    """Rows of the tasks' partial sums, added up; as many as there are keys."""
    return iter(parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns)).collect())
