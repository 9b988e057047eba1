"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.session import ship_package

# One Arrow batch sent to a Python worker holds at most this many bytes (or one
# row, if that row alone is larger), whatever the length of the texts.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes instead of only in rows."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str = "doc_id"):
    """True for rows that must not be learned from: crc32 of the id's text, mod 4, is 2.

    A null id counts as its empty text (remainder 0), so the flag is never null.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def smallest_by_hash(df: DataFrame, key: str, order: list[str], n: int, salts: int = 8) -> DataFrame:
    """The ``n`` first rows of each ``key`` by ``order``, which begins with a hash.

    First within parts of a key by that hash, so that no task reads more of a
    frequent key than those parts' first rows.
    """
    salt = Window.partitionBy(key, F.pmod(F.col(order[0]), F.lit(salts))).orderBy(*order)
    firsts = df.withColumn("__n", F.row_number().over(salt)).where(F.col("__n") <= n)
    return firsts.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
