"""Change detection core: frontier (U1), catalogue match (J1), current revision
(J2), classification (J3), per-project summary (A1), crawl candidates (U2).

Physical shape: the fetched HTML is reduced to a 64-character fingerprint plus
title/description *before* any shuffle (``digest_snapshot``), so no exchange
ever carries page bodies.  The revision pointer join (J2) runs first on the
revision id; frontier, catalogue and snapshot then meet in joins on the same
key ``(project_id, url)``, which lets Spark reuse one hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from .ranking import latest_per_key

CHANGED, NEW, UNCHANGED = "changed", "new", "unchanged"

# --- fixed values: reason texts --------------------------------------------
REASON_FETCH_FAILED = "Error checking content hash: fetch failed"
REASON_NO_REVISION = "No previous revision found"
REASON_NO_HASH = "No stored content hash"
REASON_SAME = "No changes detected"
# "HTTP {code} on full fetch";  "Content hash changed: {old[:8]}... -> {new[:8]}..."
# ---------------------------------------------------------------------------


def digest_snapshot(snapshot: DataFrame) -> DataFrame:
    """Map-side digest of fetched pages: fingerprint, title and description.

    Only OK pages are parsed; the body column is dropped here so that nothing
    downstream shuffles HTML.
    """
    stripped = text.strip_blocks("body")
    ok = F.col("status_code") == 200
    # Staged projections: each intermediate text is computed once and read by
    # column reference; all of it stays in the JVM.
    digest = (snapshot
              .select("project_id", "url", "status_code", F.when(ok, stripped).alias("_stripped"))
              .select("project_id", "url", "status_code",
                      F.regexp_replace("_stripped", text.TAG_RE, "").alias("_tagless"),
                      F.regexp_extract("_stripped", text.TITLE_RE, 1).alias("_title"),
                      text.description_raw_from_stripped("_stripped").alias("_desc"))
              .select("project_id", "url", "status_code",
                      F.sha2(text.collapse_space(text.decode_entities("_tagless")), 256).alias("content_sha256"),
                      text.py_strip(text.decode_entities("_title")).alias("title"),
                      text.py_strip(text.decode_entities("_desc")).alias("description")))
    # One fetch per URL: should a snapshot hold a URL twice, keep the OK one
    # (then the greatest digest) -- a partial aggregate on the join key, so the
    # join that follows reuses its partitioning.
    return latest_per_key(digest, ["project_id", "url"],
                          [(F.col("status_code") == 200), "content_sha256", "title", "description", "status_code"])


def frontier(sitemap_urls: DataFrame, pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Sitemap URLs ∪ known URLs ∪ {start URL} per project, distinct.

    The start URL gets P1 (scheme) before the union.
    """
    start = projects.select("project_id", urls.ensure_scheme("start_url").alias("url"))
    return (sitemap_urls.select("project_id", "url")
            .unionByName(pages.select("project_id", "url"))
            .unionByName(start)
            .filter(F.col("url").isNotNull())
            .distinct())


def with_current_revision(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each page with its current revision as a nullable struct.

    Pages without a pointer skip the join entirely: a left join would send every
    null key to one reducer.
    """
    revs = revisions.select(F.col("id").alias("_rev_id"),
                            F.struct(F.col("id"), F.col("content_sha256")).alias("current_revision"))
    with_ptr = pages.filter(F.col("current_revision_id").isNotNull())
    no_ptr = pages.filter(F.col("current_revision_id").isNull())
    joined = (with_ptr.join(revs, with_ptr["current_revision_id"] == revs["_rev_id"], "left")
              .drop("_rev_id"))
    return joined.unionByName(
        no_ptr.withColumn("current_revision",
                          F.lit(None).cast("struct<id:string,content_sha256:string>")))


def match_frontier(frontier_df: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs against known pages by exact URL (hit -> check, miss -> new)."""
    known = pages.select("project_id", "url", F.col("id").alias("page_id"))
    return (frontier_df.join(known, ["project_id", "url"], "left")
            .withColumn("is_known", F.col("page_id").isNotNull()))


def change_class(is_new: Column, failed: Column, status: Column, rev_id: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """Class and reason (P9) of one look at a page, in the order of checks of J3."""
    bad_status = status != 200
    no_rev = rev_id.isNull()
    no_hash = F.coalesce(old, F.lit("")) == ""
    differs = old != new
    cls = (F.when(is_new, F.lit(NEW))
           .when(failed | bad_status | no_rev | no_hash | differs, F.lit(CHANGED))
           .otherwise(F.lit(UNCHANGED)))
    reason = (F.when(is_new, F.lit(None).cast("string"))
              .when(failed, F.lit(REASON_FETCH_FAILED))
              .when(bad_status, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" on full fetch")))
              .when(no_rev, F.lit(REASON_NO_REVISION))
              .when(no_hash, F.lit(REASON_NO_HASH))
              .when(differs, F.concat(F.lit("Content hash changed: "), F.substring(old, 1, 8),
                                      F.lit("... -> "), F.substring(new, 1, 8), F.lit("...")))
              .otherwise(F.lit(REASON_SAME)))
    return cls, reason


def known_pages(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """J2 for J3: (project_id, url, page_id, old_revision_id, old_content_sha256) of the catalogue."""
    found = with_current_revision(pages.select("id", "project_id", "url", "current_revision_id"), revisions)
    return found.select("project_id", "url", F.col("id").alias("page_id"), F.col("current_revision.id").alias("old_revision_id"),
                        F.col("current_revision.content_sha256").alias("old_content_sha256"))


def classify_changes(frontier_df: DataFrame, pages: DataFrame, revisions: DataFrame,
                     digest: DataFrame) -> DataFrame:
    """New / changed / unchanged with the reason, per frontier URL.

    ``digest`` is ``digest_snapshot(snapshot)``.  Order of checks: fetch failed,
    HTTP status, no revision, no stored hash, hash differs, same.
    Output: project_id, url, page_id, change_class, change_reason,
    old_revision_id, plus the fetch digest (status_code, content_sha256, title,
    description) for the later steps.
    """
    looked = frontier_df.select("project_id", "url").join(known_pages(pages, revisions), ["project_id", "url"], "left")
    return _classified(looked, digest)


def classify_laid_out(found: DataFrame, known: DataFrame, digest: DataFrame) -> DataFrame:
    """J3 over ``known_pages`` and the digest as tables bucketed by (project_id, url): neither is moved.

    ``found``: the URLs of site maps and start pages.  What the catalogue holds is looked
    at where it lies; of what was found only the rest, which is new, is met with the
    digest.  Same rows as ``classify_changes`` over the frontier of both.
    """
    none = F.lit(None).cast("string")
    new = (found.select("project_id", "url").filter(F.col("url").isNotNull()).distinct()
           .join(known, ["project_id", "url"], "left_anti")
           .select("project_id", "url", none.alias("page_id"), none.alias("old_revision_id"), none.alias("old_content_sha256")))
    return _classified(known.filter(F.col("url").isNotNull()), digest).unionByName(_classified(new, digest))


def _classified(looked: DataFrame, digest: DataFrame) -> DataFrame:
    """Pages to look at with what is known of them, met with the digest."""
    fetched = digest.select("project_id", "url", F.lit(True).alias("_fetched"), "status_code",
                            "content_sha256", "title", "description")
    j = looked.join(fetched, ["project_id", "url"], "left")
    rev_id, old = F.col("old_revision_id"), F.col("old_content_sha256")
    cls, reason = change_class(F.col("page_id").isNull(), F.col("_fetched").isNull(), F.col("status_code"), rev_id, old, F.col("content_sha256"))
    return j.select("project_id", "url", "page_id", cls.alias("change_class"), reason.alias("change_reason"),
                    "old_revision_id", "old_content_sha256",
                    F.coalesce(F.col("_fetched"), F.lit(False)).alias("fetched"),
                    "status_code", "content_sha256", "title", "description")


def change_summary(changes: DataFrame) -> DataFrame:
    """A1: per project counts of changed / new / unchanged, total and has_changes."""
    c = F.col("change_class")
    return changes.groupBy("project_id").agg(
        F.count_if(c == CHANGED).alias("n_changed"),
        F.count_if(c == NEW).alias("n_new"),
        F.count_if(c == UNCHANGED).alias("n_unchanged"),
        F.count(F.lit(1)).alias("total_checked"),
        F.bool_or(c.isin(CHANGED, NEW)).alias("has_changes"))


def crawl_candidates(changes: DataFrame) -> DataFrame:
    """Changed pages followed by new pages (an order key instead of a union)."""
    c = F.col("change_class")
    return (changes.filter(c.isin(CHANGED, NEW))
            .withColumn("class_order", F.when(c == CHANGED, 0).otherwise(1)))
