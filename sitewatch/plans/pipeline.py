"""Whole runs over tables: site maps, changes, crawl budget, revisions, pages,
documents, artifacts, run status, notifications and the next schedule.

Runs of different projects go through each step together; a project's runs take
turns, each seeing the pages and revisions that the one before left.  A turn writes
what it produces once, to the shared scratch folder: the documents, the new
revisions and the pages it changed.  The large tables are read, never written; the
tables "after the runs" are those with the changed rows laid over them.

A run that cannot go on -- its job names no project or no address, its document
cannot be written -- ends FAILED with the reason as its summary, and the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import urls
from ..operators.bloom import bloom_filter, may_hold
from ..operators import catalog, changes as ch, crawl, index, links, runs as run_ops, webhooks as wh
from ..session import materialize
from ..sources import sitemaps
from ..sources.documents import object_names
from ..sources.keyed import overlaid
from ..sources.tables import clustered
from .crawl_job import CrawlInputs, CrawlJob

ERROR_NO_PROJECT, ERROR_BAD_URL, ERROR_NOT_WRITTEN = "Project not found: ", "Invalid URL: ", "Document could not be written: "


@dataclass(frozen=True)
class SiteTables:
    pages: DataFrame
    revisions: DataFrame            # id, page_id, content_sha256
    snapshot: DataFrame             # fetched documents: project_id, url, status_code, body
    runs: DataFrame                 # id, project_id, status, ...
    projects: DataFrame             # id, domain
    configs: DataFrame              # project_id, cron_expression, is_enabled, last_run_at, next_run_at
    webhooks: DataFrame             # id, project_id, url, is_active
    artifacts: DataFrame            # id, project_id, type, public_url, created_at
    sitemap_urls: DataFrame | None = None       # read from the snapshot's site maps where not given


@dataclass(frozen=True)
class RunResults:
    tables: SiteTables              # as they are after the runs
    changed: dict[str, DataFrame]   # of pages, runs and configs the changed and new rows; of revisions and artifacts the new ones
    changes: DataFrame              # run_id and the classified pages
    documents: DataFrame            # project_id, document, job_id, run_id
    outcomes: DataFrame             # R3 of every run
    actions: DataFrame              # R2
    outbox: DataFrame               # J11
    scheduled: DataFrame            # R4: new runs with their payloads


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failed_jobs(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs that cannot run, with the ``error``: their project does not exist, or their address is none."""
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known")).distinct()
    url = urls.ensure_scheme("start_url")
    error = (F.when(F.col("_known").isNull(), F.concat(F.lit(ERROR_NO_PROJECT), F.coalesce(F.col("project_id").cast("string"), F.lit(""))))
             .when(~urls.is_valid_url(url), F.concat(F.lit(ERROR_BAD_URL), F.coalesce("start_url", F.lit("")))))
    return jobs.join(known, "project_id", "left").withColumn("error", error).filter(F.col("error").isNotNull()).drop("_known")


def _failed_outcomes(jobs: DataFrame, error: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return jobs.select("job_id", "run_id", "project_id", F.lit(S.RUN_FAILED).alias("status"), none.alias("document"),
                       none.alias("llms_txt_url"), error.alias("summary"))


def site_frontier(tables: SiteTables, sites: DataFrame, follow_links: bool) -> DataFrame:
    """The URLs that site maps and, if wanted, links give for the sites."""
    found = tables.sitemap_urls
    if found is None:
        found = sitemaps.expand_index(sitemaps.sitemap_docs(tables.snapshot, sites), tables.snapshot)
    if follow_links:
        depth = F.coalesce(F.max("crawl_depth"), F.lit(S.DEFAULT_MAX_DEPTH)).alias("crawl_depth")
        depths = tables.configs.groupBy("project_id").agg(depth)
        limited = sites.join(depths, "project_id", "left").fillna(S.DEFAULT_MAX_DEPTH, ["crawl_depth"])
        linked = links.depth_limited_frontier(links.link_edges(tables.snapshot), limited, None)
        found = found.select("project_id", "url").unionByName(linked.select("project_id", "url")).distinct()
    return found


def run_pipeline(jobs: DataFrame, tables: SiteTables, now, public_base: str, max_pages: int = S.DEFAULT_MAX_PAGES_JOB,
                 store: str | None = None, follow_links: bool = False) -> RunResults:
    """Run every job: (project_id, start_url, job_id, run_id[, is_scheduled, is_initial]).

    With ``store`` the documents are written there, an object each (S7).  With
    ``follow_links`` pages within the project's ``crawl_depth`` links of the start page
    (X2) count as found, too.  Without jobs the tables stay as they are.
    """
    for flag in ("is_scheduled", "is_initial"):
        if flag not in jobs.columns:
            jobs = jobs.withColumn(flag, F.lit(False))
    jobs = materialize(jobs, "jobs")
    failed = materialize(failed_jobs(jobs, tables.projects), "failed-jobs")
    rest = materialize(jobs.join(failed.select("run_id"), "run_id", "left_anti"), "jobs")
    sitemap = tables.sitemap_urls
    if sitemap is None or follow_links:
        sitemap = materialize(site_frontier(tables, rest.select("project_id", "start_url").distinct(), follow_links), "sitemap-urls")
    # of the sites that run alone; every turn reads the digest, so bodies are parsed once
    sites = bloom_filter(rest.select("project_id").distinct(), ["project_id"])
    snapshot, mine = (may_hold(t, ["project_id"], sites) for t in (tables.snapshot, tables.pages))
    digest = clustered(ch.digest_snapshot(snapshot), ["project_id", "url"], "digest")
    pages, revisions, changed_pages = mine, tables.revisions, None
    changes, documents, artifacts, new_revisions = [], [], [], []
    outcomes = [_failed_outcomes(failed, F.col("error"))]
    while True:
        job = CrawlJob(CrawlInputs(sitemap, pages, revisions, snapshot, rest, digest), max_pages)
        job.turn = materialize(job.turn, "turn")
        job.frontier = job.frontier.join(job.turn.select("project_id"), "project_id", "left_semi")
        job.cut_changes()
        changes.append(job.changes.join(job.turn.select("project_id", "run_id"), "project_id"))
        job.crawled_with_ids = materialize(job.crawled_with_ids, "crawled")
        docs = materialize(job.run_documents, "documents")
        lost = None
        if store is not None:
            lost = _write_documents(docs, store)
            docs = docs.join(lost.select("run_id"), "run_id", "left_anti").select(*docs.columns)
        new_revisions.append(materialize(job.new_revisions(now), "revisions"))
        touched = materialize(crawl.page_changes(pages, job.crawled_with_ids, now), "page-changes")
        changed_pages = touched if changed_pages is None else materialize(overlaid(changed_pages, touched, "id"), "page-changes")
        pages = overlaid(mine, changed_pages, "id")
        revisions = revisions.unionByName(new_revisions[-1].select(*revisions.columns))
        documents.append(docs)
        artifacts.append(index.artifact_rows(docs, now, public_base, *([store] if store else [])))
        ran = job.turn.select("project_id", "job_id", "run_id")
        if lost is not None:
            outcomes.append(_failed_outcomes(lost, F.col("error")))
            ran = ran.join(lost.select("run_id"), "run_id", "left_anti")
        outcomes.append(materialize(run_ops.job_outcome(ran, None, docs.select("project_id", "document"), public_base), "outcomes"))
        rest = materialize(job.later, "later-jobs")
        if rest.isEmpty():
            break
    done = _union(outcomes)
    status = done.select("run_id", "status", "summary", F.lit(2).alias("seq")).unionByName(
        jobs.select("run_id", F.lit(S.RUN_IN_PROGRESS).alias("status"), F.lit(None).cast("string").alias("summary"), F.lit(1).alias("seq")))
    due = tables.runs.join(jobs.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi").select(*tables.runs.columns)
    ran = materialize(run_ops.apply_transitions(due, status, now), "runs")

    made = _union(artifacts).select(*tables.artifacts.columns)
    arts = tables.artifacts.unionByName(made)
    latest = catalog.latest_artifact_by_project(arts).select("project_id", F.col("public_url").alias("latest_url"))
    finished = done.select(F.col("run_id").alias("id"), "project_id", "status", "llms_txt_url").join(
        jobs.select(F.col("run_id").alias("id"), "is_scheduled", "is_initial"), "id")
    actions = materialize(run_ops.completion_actions(finished, latest), "actions")
    outbox = wh.fanout(actions, tables.webhooks, now)
    todo = actions.filter("schedule_next").select("project_id").distinct()
    scheduled = run_ops.schedule_next(tables.configs.join(todo, "project_id", "left_semi"), tables.projects, now)
    scheduled = materialize(scheduled, "scheduled")
    per_project = actions.groupBy("project_id").agg(F.max("touch_last_run").alias("_touched")).join(
        scheduled.select("project_id", F.col("next_run_at").alias("_next")), "project_id", "left")
    configs = tables.configs.join(per_project, "project_id").withColumns({
        "last_run_at": F.when(F.col("_touched"), F.lit(now).cast("timestamp")).otherwise(F.col("last_run_at")),
        "next_run_at": F.coalesce("_next", "next_run_at")}).select(*tables.configs.columns)
    configs = materialize(configs, "configs")
    queued = scheduled.select(F.col("run_id").alias("id"), "project_id", "status", "created_at")
    changed_runs = ran.unionByName(queued, allowMissingColumns=True)
    columns = [*tables.runs.columns, *(c for c in changed_runs.columns if c not in tables.runs.columns)]
    runs = (tables.runs.join(changed_runs.select("id"), "id", "left_anti")
            .unionByName(changed_runs, allowMissingColumns=True).select(*columns))
    after = replace(tables, pages=overlaid(tables.pages, changed_pages, "id"), revisions=revisions, runs=runs, configs=overlaid(tables.configs, configs, "project_id"), artifacts=arts)
    changed = {"pages": changed_pages, "revisions": _union(new_revisions), "runs": changed_runs, "configs": configs, "artifacts": made}
    return RunResults(after, changed, _union(changes), _union(documents), done, actions, outbox, scheduled)


def _write_documents(docs: DataFrame, store: str) -> DataFrame:
    """Write a turn's documents; those that got no object, with the ``error``."""
    names = docs.withColumn("file_name", index.artifact_file_name(F.col("job_id")))
    index.write_documents(docs, store)
    lost = names.filter(F.octet_length("document") > 0).join(object_names(docs.sparkSession, store).select("file_name"), "file_name", "left_anti")
    return materialize(lost.withColumn("error", F.concat(F.lit(ERROR_NOT_WRITTEN), "file_name")), "lost-documents")
