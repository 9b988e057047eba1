"""The registered query set: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory.  Each reads whole driver tables (through the
``fx_*`` views) and returns a DataFrame whose column names equal those of its
DuckDB twin in ``oracle_sql``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import crawl, index
from .crawl_job import CrawlInputs, CrawlJob
from .fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Budgets used by the queries: the job's default, and the budget of the
# reference's own budget test (5 pages).
SITE_INDEX_MAX_PAGES = 100
# "now" of lifecycle queries: passed as an argument, never read from the clock.
FIXED_NOW = "2024-03-15 12:00:00"
FIXED_NOW_ISO = "2024-03-15T12:00:00+00:00"
PUBLIC_BASE = "https://store.example/public"
BUDGET_TEST_MAX_PAGES = 5


def register(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)``; the session is pinned to UTC first, as
    every timestamp expression of the data model assumes it."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def crawl_job(spark: SparkSession, sf_dir: str, max_pages: int = SITE_INDEX_MAX_PAGES) -> CrawlJob:
    fx = Fixtures(spark, sf_dir)
    inputs = CrawlInputs(sitemap_urls=fx.sitemap, pages=fx.pages, revisions=fx.revisions,
                         snapshot=fx.fetch.select("project_id", "url", "status_code", "body"),
                         jobs=fx.all_jobs)
    return CrawlJob(inputs, max_pages)


from . import queries_crawl  # noqa: E402,F401  (registers the crawl queries)
from . import queries_model  # noqa: E402,F401  (read model)
from . import queries_lifecycle  # noqa: E402,F401  (run lifecycle, webhooks)
from . import queries_sources  # noqa: E402,F401  (sources, URL and text functions)
from . import queries_maint  # noqa: E402,F401  (cascade delete, patches, audit)
from . import queries_streaming  # noqa: E402,F401  (ST1-ST4)
from . import queries_functions  # noqa: E402,F401  (scalar expressions)
