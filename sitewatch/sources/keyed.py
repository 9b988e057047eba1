"""Tables at rest of which an update rewrites only what it touches.

Rows lie in folders ``bucket=<n>`` by the hash of a column.  ``merged`` gives the new
rows of the buckets that some changed rows fall in, and ``replace`` puts such rows
in place of those buckets by Spark's dynamic partition overwrite; the other buckets'
files stay as they are.  A run changes pages of its own sites, so with more buckets
than it has sites it writes in proportion to them.

To be safe from a driver that is lost in between, write ``merged`` somewhere before
``replace``: putting the same rows in place again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKET = "bucket"


class KeyedTable:
    """A table at ``path``, one row a ``key``; a row's ``bucket_by`` never changes.

    ``buckets`` belongs to the table: it must be the same whenever it is opened.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, bucket_by: str, buckets: int = 64):
        self.spark, self.path, self.key, self.bucket_by, self.buckets = spark, path, key, bucket_by, buckets
        self.schema = schema
        self.stored_schema = StructType(list(schema.fields)).add(BUCKET, IntegerType())

    def bucketed(self, rows: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")
        return rows.select(*self.schema.names, number.alias(BUCKET))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.stored_schema).parquet(self.path)

    def _write(self, rows: DataFrame, overwrite: str) -> None:
        # a bucket's rows come together, in parts where a site is large
        (rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", overwrite)
         .partitionBy(BUCKET).parquet(self.path))

    def create(self, rows: DataFrame) -> None:
        self._write(self.bucketed(rows), "static")

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def merged(self, changes: DataFrame) -> DataFrame:
        """The rows, with their bucket, of all buckets that ``changes`` touch, as they are after them.

        A changed row stands for the row of its key, or is a new one.  ``changes``
        is read twice; the driver holds the numbers of the touched buckets.
        """
        new = self.bucketed(changes)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        old = self._stored().filter(F.col(BUCKET).isin(touched))
        return old.join(new.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new)

    def replace(self, rows: DataFrame) -> None:
        """Put the rows of ``merged``, read from where they were written, in place of their buckets."""
        self._write(rows.select(*self.schema.names, BUCKET), "dynamic")


def overlaid(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the changed rows in place of those of their keys, without writing it."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))
