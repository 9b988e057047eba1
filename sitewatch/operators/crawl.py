"""Crawl step: per-project budget (W1), crawled pages (F3/A3), crawl result
(A2), revision de-duplication (J10), new revisions (S9 rows), page upsert
(S10 rows) and the current-revision pointer (W7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..schemas import DEFAULT_MAX_DEPTH
from ..session import materialize
from .bloom import bloom_filter, may_hold
from .changes import CHANGED, NEW, crawl_candidates
from .ranking import latest_per_key, rank_within


PAGE_ID_PREFIX, REVISION_ID_PREFIX = "pg_", "rev_"


def _lit_ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def start_urls(projects: DataFrame) -> DataFrame:
    """(project_id, url) of each project's start page, scheme ensured."""
    return projects.select("project_id", urls.ensure_scheme("start_url").alias("url"))


def crawl_budget(changes: DataFrame, projects: DataFrame, max_pages: int) -> DataFrame:
    """Up to ``max_pages`` changed+new pages per project; the start URL is first
    and always kept (even with ``max_pages`` = 0).  Order: start, changed by url,
    new by url.

    The start page is flagged by an equi-join on ``(project_id, url)`` -- an even
    key -- rather than by joining the project table on ``project_id``, which
    would put a huge site into one task.  Up to the session's window group limit
    the rank filter is a plain ``row_number <= n``, of which Spark keeps at most
    ``n`` rows per project in every map task before the shuffle; beyond it the
    rank comes from ``rank_within``, which splits a site over many tasks.
    """
    starts = start_urls(projects).withColumn("is_start", F.lit(True))
    cand = (crawl_candidates(changes)
            .join(starts, ["project_id", "url"], "left")
            .withColumn("is_start", F.coalesce(F.col("is_start"), F.lit(False))))
    order = [F.col("is_start").desc(), F.col("class_order"), F.col("url"), F.col("page_id").asc_nulls_first()]
    if max_pages > int(changes.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        ranked = rank_within(cand, ["project_id"], order, "crawl_rank")
        return ranked.withColumn("crawl_rank", F.col("crawl_rank").cast("int")).filter(F.col("crawl_rank") <= F.lit(max_pages))
    w = Window.partitionBy("project_id").orderBy(*order)
    ranked = cand.withColumn("crawl_rank", F.row_number().over(w))
    if max_pages >= 1:
        return ranked.filter(F.col("crawl_rank") <= F.lit(max_pages))
    return ranked.filter((F.col("crawl_rank") <= F.lit(1)) & F.col("is_start"))


def crawled_pages(budget: DataFrame) -> DataFrame:
    """F3 + A3: budgeted pages whose fetch returned 200 (only those get a revision)."""
    return budget.filter(F.col("fetched") & (F.col("status_code") == 200))


PAGES_ARRAY = "array<struct<url:string,title:string,description:string,page_id:string,revision_id:string>>"


def crawl_result(changes: DataFrame, crawled_with_ids: DataFrame, projects: DataFrame,
                 max_pages: int, max_depth: int = DEFAULT_MAX_DEPTH) -> DataFrame:
    """A2: one row per project: start_url, pages_crawled, max_pages, max_depth,
    changes_detected, class counts and the ordered ``pages`` array.

    ``pages`` is bounded by the budget.  The changed/new/unchanged lists stay
    rows of ``changes`` (they are not bounded, so they are not collected).
    When nothing changed the project has 0 pages and ``changes_detected`` false.
    """
    c = F.col("change_class")
    per_project = changes.groupBy("project_id").agg(
        F.count_if(c == CHANGED).alias("n_changed"),
        F.count_if(c == NEW).alias("n_new"),
        F.count_if(c == "unchanged").alias("n_unchanged"))
    page_struct = F.struct("crawl_rank", "url", "title", "description", "page_id", "revision_id")
    pages = crawled_with_ids.groupBy("project_id").agg(
        F.array_sort(F.collect_list(page_struct)).alias("_pages"))
    detected = (F.col("n_changed") + F.col("n_new")) > 0
    plain = F.transform(F.coalesce(F.col("_pages"), F.array()),
                        lambda p: F.struct(p["url"].alias("url"), p["title"].alias("title"),
                                           p["description"].alias("description"),
                                           p["page_id"].alias("page_id"), p["revision_id"].alias("revision_id")))
    return (projects.select("project_id", "start_url")
            .join(per_project, "project_id")
            .join(pages, "project_id", "left")
            .select("project_id", "start_url",
                    F.when(detected, F.size(plain)).otherwise(F.lit(0)).alias("pages_crawled"),
                    F.lit(max_pages).alias("max_pages"), F.lit(max_depth).alias("max_depth"),
                    detected.alias("changes_detected"),
                    "n_changed", "n_new", "n_unchanged",
                    F.when(detected, plain).otherwise(F.array().cast(PAGES_ARRAY)).alias("pages")))


def new_page_id(project_id: Column, url: Column) -> Column:
    """Repeatable id for a page first seen in a run."""
    return F.concat(F.lit(PAGE_ID_PREFIX), F.sha2(F.concat_ws("|", project_id, url), 256))


def new_revision_id(page_id: Column, run_id: Column) -> Column:
    """Repeatable id for a revision written by a run."""
    return F.concat(F.lit(REVISION_ID_PREFIX), F.sha2(F.concat_ws("|", page_id, run_id), 256))


def dedup_revisions(crawled: DataFrame, run_id: Column | str) -> DataFrame:
    """A crawled page whose new hash equals its old revision's hash keeps the
    old revision id (only ``last_seen_at`` is touched); any other page gets a new
    revision id.  New pages get a page id first.  The page counts as crawled
    either way.

    ``crawled`` carries ``old_revision_id`` and ``old_content_sha256`` from J3,
    so no second lookup of the revision table is needed.
    """
    run = F.col(run_id) if isinstance(run_id, str) else run_id
    is_new_page = F.col("page_id").isNull()
    page_id = F.coalesce(F.col("page_id"), new_page_id(F.col("project_id"), F.col("url")))
    same = (F.col("old_revision_id").isNotNull() & F.col("old_content_sha256").isNotNull()
            & (F.col("old_content_sha256") == F.col("content_sha256")))
    same = F.coalesce(same, F.lit(False))
    return (crawled
            .withColumn("is_new_page", is_new_page)
            .withColumn("page_id", page_id)
            .withColumn("is_new_revision", ~same)
            .withColumn("revision_id", F.when(same, F.col("old_revision_id"))
                        .otherwise(new_revision_id(F.col("page_id"), run))))


def new_revisions(dedup: DataFrame, snapshot: DataFrame, run_id: Column | str, now) -> DataFrame:
    """S9 rows: one revision per really new content.

    The raw bodies come from the 200 responses of the snapshot.  A Bloom filter of the
    fresh pages dismisses the others at the scan, so what is shuffled is in proportion to
    the new revisions.  Of a URL that the snapshot holds with several bodies, the digest's
    choice is the one with the revision's fingerprint (the smallest, if several have
    it); no other body is hashed again.
    """
    run = F.col(run_id) if isinstance(run_id, str) else run_id
    key = ["project_id", "url"]
    fresh = materialize(dedup.filter(F.col("is_new_revision")).select(
        *key, "revision_id", "page_id", run.alias("_run"), "content_sha256", "title", "description", "change_reason"), "fresh")
    bodies = may_hold(snapshot.filter(F.col("status_code") == 200).select(*key, F.col("body").alias("content")), key, bloom_filter(fresh, key))
    found = bodies.join(fresh, key)
    same_url = Window.partitionBy(*key)
    several = F.min("content").over(same_url) != F.max("content").over(same_url)
    found = (found.withColumn("_several", several).filter(~F.col("_several") | (text.fingerprint("content") == F.col("content_sha256")))
             .withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "revision_id").orderBy("content"))).filter("_nth = 1"))
    return found.select(F.col("revision_id").alias("id"), "page_id", F.col("_run").alias("run_id"), "content",
                        "content_sha256", "title", F.col("description").alias("meta_description"),
                        _lit_ts(now).alias("created_at"),
                        F.to_json(F.struct(F.coalesce(F.col("change_reason"), F.lit("Unknown"))
                                           .alias("change_reason"))).alias("metadata"))


def upsert_pages(pages: DataFrame, dedup: DataFrame, now) -> DataFrame:
    """The page table after a run.

    New pages are inserted with defaults (P4/P28) and point at their revision;
    existing crawled pages move ``current_revision_id`` when a new revision was
    written and always get ``last_seen_at``.  One full outer join on the page
    id (so the run's result is read once): matched = update, page only =
    unchanged, run only = insert.  Returns the whole new snapshot; write it to
    a new path (never over the one being read).
    """
    return _upserted(pages, dedup, now, "full_outer")


def page_changes(pages: DataFrame, dedup: DataFrame, now) -> DataFrame:
    """Only the rows that a run updates or inserts, as they are after it."""
    return _upserted(pages, dedup, now, "right")


def _upserted(pages: DataFrame, dedup: DataFrame, now, how: str) -> DataFrame:
    ts = _lit_ts(now)
    d = dedup.select(F.col("page_id").alias("_id"), F.col("project_id").alias("_project_id"),
                     F.col("url").alias("_url"), F.col("revision_id").alias("_rev"),
                     F.col("is_new_revision").alias("_newrev"), F.col("is_new_page").alias("_newpage"))
    j = pages.join(d, pages["id"] == d["_id"], how)
    hit = F.col("_id").isNotNull()
    insert = F.col("id").isNull() & hit
    defaults = {
        "id": F.col("_id"), "project_id": F.col("_project_id"), "url": F.col("_url"),
        "path": urls.page_path(F.col("_url")), "canonical_url": F.col("_url"), "last_seen_at": ts,
        "render_mode": F.lit("STATIC"), "discovered_at": ts, "is_indexable": F.lit(True),
        "metadata": F.lit("{}"), "current_revision_id": F.col("_rev"),
    }
    out = []
    for c in pages.columns:
        t = pages.schema[c].dataType
        if c == "current_revision_id":
            upd = F.when(hit & F.col("_newrev"), F.col("_rev")).otherwise(F.col(c))
        elif c == "last_seen_at":
            upd = F.when(hit, ts).otherwise(F.col(c))
        else:
            upd = F.col(c)
        ins = defaults.get(c, F.lit(None))
        out.append(F.when(insert, ins.cast(t)).otherwise(upd.cast(t)).alias(c))
    return j.select(*out)


def current_revision(revisions: DataFrame) -> DataFrame:
    """Latest revision per page (by created_at, then id) as a pointer.

    ``max_by`` is a partial aggregate: each map task keeps one candidate per
    page, so a page with very many revisions never lands in one task whole.
    """
    return revisions.groupBy("page_id").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("current_revision_id"))
