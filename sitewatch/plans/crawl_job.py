"""The per-run crawl job over all projects at once (change detection ->
budget -> crawl -> revisions -> site index), as one lazy DataFrame graph.

Inputs are tables: sitemap URLs, known pages, revisions, the crawl snapshot and
the projects/jobs to run.  Nothing is collected; the boundaries are the
shuffles on (project_id, url), on the revision id, and on project_id for the
bounded per-project aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import crawl, index
from ..operators.ranking import latest_per_key
from ..schemas import DEFAULT_MAX_PAGES_JOB
from ..sources.tables import clustered


@dataclass
class CrawlInputs:
    sitemap_urls: DataFrame   # project_id, url
    pages: DataFrame          # id, project_id, url, current_revision_id, ...
    revisions: DataFrame      # id, page_id, content_sha256, ...
    snapshot: DataFrame       # project_id, url, status_code, body
    jobs: DataFrame           # project_id, start_url, job_id, run_id; a project may have several runs
    digest: DataFrame | None = None     # digest_snapshot(snapshot), where it is there already


class CrawlJob:
    """Lazily wired DataFrames of one run of every project in ``inputs.jobs``.

    Of a project with several runs the first one (by run id) has its ``turn``;
    the ``later`` ones must see what it leaves behind, so they are jobs of
    another ``CrawlJob`` over the tables as they are then (``plans.pipeline``).
    """

    def __init__(self, inputs: CrawlInputs, max_pages: int = DEFAULT_MAX_PAGES_JOB):
        self.inputs = inputs
        self.max_pages = max_pages

    @cached_property
    def turn(self) -> DataFrame:
        return latest_per_key(self.inputs.jobs, ["project_id"], ["run_id"], newest=False)

    @cached_property
    def later(self) -> DataFrame:
        return self.inputs.jobs.join(self.turn.select("run_id"), "run_id", "left_anti")

    @cached_property
    def projects(self) -> DataFrame:
        return self.turn.select("project_id", "start_url")

    @cached_property
    def digest(self) -> DataFrame:
        given = self.inputs.digest
        return ch.digest_snapshot(self.inputs.snapshot) if given is None else given

    @cached_property
    def frontier(self) -> DataFrame:
        return ch.frontier(self.inputs.sitemap_urls, self.inputs.pages, self.projects)

    @cached_property
    def changes(self) -> DataFrame:
        return ch.classify_changes(self.frontier, self.inputs.pages, self.inputs.revisions, self.digest)

    def laid_out(self) -> "CrawlJob":
        """Lay the catalogue with its revision pointers and the digest out by (project_id, url),
        bucketed tables, and classify over them: the joins move neither."""
        key = ["project_id", "url"]
        known = clustered(ch.known_pages(self.inputs.pages, self.inputs.revisions), key, "known-pages")
        self.__dict__["digest"] = clustered(self.digest, key, "digest")
        found = self.inputs.sitemap_urls.select(*key).unionByName(crawl.start_urls(self.projects))
        self.__dict__["changes"] = ch.classify_laid_out(found, known, self.digest)
        return self

    def cut_changes(self) -> "CrawlJob":
        """Write the change table once to the shared folder and read it back,
        for outputs that need it twice (the per-project counts and the budget):
        the joins over every URL then run once instead of once per branch."""
        from ..session import materialize
        self.__dict__["changes"] = materialize(self.changes, "changes")
        for dependent in ("summary", "budget", "crawled", "crawled_with_ids", "documents", "crawl_results"):
            self.__dict__.pop(dependent, None)
        return self

    @cached_property
    def summary(self) -> DataFrame:
        return ch.change_summary(self.changes)

    @cached_property
    def budget(self) -> DataFrame:
        return crawl.crawl_budget(self.changes, self.projects, self.max_pages)

    @cached_property
    def crawled(self) -> DataFrame:
        return crawl.crawled_pages(self.budget)

    @cached_property
    def crawled_with_ids(self) -> DataFrame:
        runs = self.turn.select("project_id", "run_id")
        return crawl.dedup_revisions(self.crawled.join(runs, "project_id"), "run_id")

    @cached_property
    def documents(self) -> DataFrame:
        # With a budget of at least one page, a non-empty budget is the same
        # as "has changes", so no second pass over the change table is needed.
        summary = self.summary if self.max_pages < 1 else None
        return index.site_index(self.budget, self.projects, summary)

    @cached_property
    def run_documents(self) -> DataFrame:
        """``documents`` with their run and job."""
        return self.documents.join(self.turn.select("project_id", "job_id", "run_id"), "project_id")

    @cached_property
    def crawl_results(self) -> DataFrame:
        return crawl.crawl_result(self.changes, self.crawled_with_ids, self.projects, self.max_pages)

    def new_revisions(self, now) -> DataFrame:
        return crawl.new_revisions(self.crawled_with_ids, self.inputs.snapshot, "run_id", now)

    def upserted_pages(self, now) -> DataFrame:
        return crawl.upsert_pages(self.inputs.pages, self.crawled_with_ids, now)

    def artifacts(self, now, public_base: str) -> DataFrame:
        return index.artifact_rows(self.run_documents, now, public_base)
