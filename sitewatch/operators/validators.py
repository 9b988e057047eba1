"""Header pre-filter (X1): pages whose validators prove them unchanged are not read.

A response's ETag or Last-Modified header, stored with the revision, is compared with that
of the new fetch before any body is looked at.  ``header_prefilter`` reads the
validators of the snapshot alone; ``bodies_to_read`` then reads bodies, and only in the
folders of sites that have something to read (``sources.tables.write_snapshot``) and of the
pages that a Bloom filter of these lets through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import site_bucket
from .bloom import bloom_filter, may_hold
from .changes import UNCHANGED

REASON_ETAG, REASON_LAST_MODIFIED = "Not modified: same ETag", "Not modified: same Last-Modified"
KEY = ["project_id", "url"]


def weak_etag(etag: Column) -> Column:
    """An ETag as weak comparison sees it: without ``W/``; null if it is none."""
    bare = F.regexp_replace(F.trim(etag), "^[Ww]/", "")
    return F.when(bare != "", bare)


def not_modified(old_etag: Column, old_modified: Column, etag: Column, modified: Column) -> Column:
    """The reason why a page is unchanged for certain, else null.

    ETags decide where both sides have one; otherwise equal Last-Modified headers do.
    """
    old, new = weak_etag(old_etag), weak_etag(etag)
    both = old.isNotNull() & new.isNotNull()
    same_time = (F.trim(old_modified) == F.trim(modified)) & (F.trim(modified) != "")
    return F.when(both & (old == new), F.lit(REASON_ETAG)).when(~both & same_time, F.lit(REASON_LAST_MODIFIED))


def header_prefilter(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """(project_id, url, status_code, reason, read): what the validators say of each fetched page.

    ``snapshot`` has project_id, url, status_code, etag and last_modified, and may have bodies,
    which are not read.  ``stored``: project_id, url, etag, last_modified and content_sha256
    of the current revision.  A page may be left unread only if it was answered with 200
    and has a stored hash to stand for it.
    """
    heads = snapshot.select(*KEY, "status_code", "etag", "last_modified")
    known = stored.filter(F.coalesce("content_sha256", F.lit("")) != "").select(*KEY, F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    j = heads.join(known, KEY, "left")
    reason = F.when(F.col("status_code") == 200, not_modified(F.col("_etag"), F.col("_modified"), F.col("etag"), F.col("last_modified")))
    return j.select(*KEY, "status_code", reason.alias("reason"), reason.isNull().alias("read"))


def bodies_to_read(spark: SparkSession, path: str, decided: DataFrame, buckets: int = 64) -> DataFrame:
    """The rows of the snapshot at ``path`` (``write_snapshot``) that ``decided`` (read twice) says to read."""
    wanted = materialize(decided.filter("read").select(*KEY), "to-read")
    folders = [r[0] for r in wanted.select(site_bucket(buckets)).distinct().collect()]      # numbers below ``buckets``
    rows = spark.read.parquet(path).filter(F.col("bucket").isin(folders)).drop("bucket")
    return may_hold(rows, KEY, bloom_filter(wanted, KEY)).join(wanted, KEY, "left_semi")


def unread_changes(decided: DataFrame) -> DataFrame:
    """J3's rows for pages that were not read: unchanged, with the validator as the reason."""
    return decided.filter(~F.col("read")).select(*KEY, F.lit(UNCHANGED).alias("change_class"), F.col("reason").alias("change_reason"))
