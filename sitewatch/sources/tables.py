"""Reading the input tables (S1 crawl snapshot, S6 page catalogue, ...)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import scratch_table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages ``(project_id, url, status_code, body)`` with a fixed schema.

    A page that has no row here is a page whose fetch failed.
    """
    return spark.read.schema(schemas.SNAPSHOT).parquet(path)


def snapshot_view(df: DataFrame) -> DataFrame:
    """S1 on an existing DataFrame: cast to the snapshot schema, nothing else."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SNAPSHOT.fields])


def existing_pages(pages: DataFrame, project_ids: DataFrame | None = None) -> DataFrame:
    """Known pages with the fixed catalogue column list.

    ``project_ids`` (one column ``project_id``) limits the read to some projects
    with a semi join; Catalyst prunes every other column of the page table.
    """
    cols = [c for c in schemas.PAGE_CATALOGUE_COLUMNS if c in pages.columns]
    out = pages.select(*cols)
    if project_ids is not None:
        out = out.join(project_ids.select("project_id").distinct(), "project_id", "left_semi")
    return out


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` at ``path`` bucketed and sorted by ``keys``, and read it back as a table.

    Spark then knows how the rows lie: joins and aggregates on ``keys`` with at most
    that many shuffle partitions read the buckets as they are, without an exchange of this
    side.  One file a bucket; the number of buckets is the session's number
    of shuffle partitions unless given.  The table's name lives in this session's
    catalog, its files stay at ``path``.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name))
    return spark.table(name)


def clustered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder in buckets of ``keys``, for several joins on them."""
    return write_bucketed(df, scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}"), keys)


def write_snapshot(snapshot: DataFrame, path: str, buckets: int = 64) -> None:
    """A crawl snapshot at rest in folders ``bucket=<n>`` by the hash of the site, so that later reads
    can leave out the bodies of sites that they do not need."""
    (snapshot.withColumn("bucket", site_bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))


def site_bucket(buckets: int):
    return F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")
