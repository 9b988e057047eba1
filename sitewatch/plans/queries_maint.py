"""Registered queries of maintenance operators: J12 J13 A8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from . import oracle as O
from .fixtures import Fixtures
from .queries import register


def _tables(fx: Fixtures) -> dict:
    return {"projects": fx.projects_tbl, "project_configs": fx.project_configs, "runs": fx.runs,
            "webhooks": fx.webhooks, "webhook_events": fx.webhook_events, "artifacts": fx.artifacts}


def _page_tables(fx: Fixtures) -> dict:
    """Pages, revisions and artifacts of the read model: a page per order, a revision per
    line, some of them written by (or current for) something of another project."""
    orders, lines = fx.table("orders"), fx.table("lineitem")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pages = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
                          (F.col("o_orderkey") * 10 + F.when(F.col("o_orderkey") % 4 == 0, 11).otherwise(1)).alias("current_revision_id"))
    revisions = lines.select((ok * 10 + ln).alias("id"), ok.alias("page_id"), F.when(ln % 2 == 0, ok + 1).otherwise(ok).alias("run_id"))
    return {"pages": pages, "page_revisions": revisions, "artifacts": fx.artifacts}


@register("cascade_delete", O.with_fx("""WITH gone AS (SELECT id FROM fx_projects_tbl WHERE id NOT IN (SELECT project_id FROM fx_project_configs)),
   pg AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderkey*10 + CASE WHEN o_orderkey%4=0 THEN 11 ELSE 1 END AS current_revision_id FROM orders),
   rv AS (SELECT l_orderkey*10+l_linenumber AS id, l_orderkey AS page_id, CASE WHEN l_linenumber%2=0 THEN l_orderkey+1 ELSE l_orderkey END AS run_id FROM lineitem),
   dead_runs AS (SELECT id FROM fx_runs WHERE project_id IN (SELECT id FROM gone)),
   dead_pages AS (SELECT id FROM pg WHERE project_id IN (SELECT id FROM gone)),
   dead_rv AS (SELECT id FROM rv WHERE page_id IN (SELECT id FROM dead_pages)),
   dead_wh AS (SELECT id FROM fx_webhooks WHERE project_id IN (SELECT id FROM gone))
   SELECT 'projects' AS table_name, count(*) AS n_rows, 0 AS n_null_refs FROM fx_projects_tbl WHERE id NOT IN (SELECT id FROM gone)
   UNION ALL SELECT 'project_configs', count(*), 0 FROM fx_project_configs WHERE project_id NOT IN (SELECT id FROM gone)
   UNION ALL SELECT 'runs', count(*), 0 FROM fx_runs WHERE project_id NOT IN (SELECT id FROM gone)
   UNION ALL SELECT 'webhooks', count(*), 0 FROM fx_webhooks WHERE project_id NOT IN (SELECT id FROM gone)
   UNION ALL SELECT 'webhook_events', count(*), count(*) FILTER (WHERE webhook_id IN (SELECT id FROM dead_wh)) FROM fx_webhook_events
   UNION ALL SELECT 'pages', count(*), count(*) FILTER (WHERE current_revision_id IN (SELECT id FROM dead_rv)) FROM pg WHERE id NOT IN (SELECT id FROM dead_pages)
   UNION ALL SELECT 'page_revisions', count(*), count(*) FILTER (WHERE run_id IN (SELECT id FROM dead_runs)) FROM rv WHERE page_id NOT IN (SELECT id FROM dead_pages)
   UNION ALL SELECT 'artifacts', count(*), count(*) FILTER (WHERE run_id IN (SELECT id FROM dead_runs)) FROM fx_artifacts"""))
def q_cascade_delete(spark, sf_dir):
    """Delete every project that has no configuration."""
    fx = Fixtures(spark, sf_dir)
    gone = fx.projects_tbl.join(fx.project_configs.select(F.col("project_id").alias("id")), "id", "left_anti").select("id")
    out = catalog.cascade_delete(_tables(fx) | _page_tables(fx), gone)
    ref_col = {child: col for child, col, _ in catalog.SET_NULL}
    parts = []
    for name in ("projects", "project_configs", "runs", "webhooks", "webhook_events", "pages", "page_revisions", "artifacts"):
        df = out[name]
        nulls = (F.count_if(F.col(ref_col[name]).isNull()) if name in ref_col else F.lit(0).cast("bigint"))
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_null_refs"))
                     .select(F.lit(name).alias("table_name"), "n_rows", "n_null_refs"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@register("patch_update", O.with_fx("""SELECT id, created_by, CASE WHEN id%2=0 THEN upper(name) ELSE name END AS name,
   CASE WHEN id%3=0 THEN NULL ELSE domain END AS domain FROM fx_projects_tbl"""))
def q_patch_update(spark, sf_dir):
    """Rename even ids, clear the domain of ids divisible by 3 (explicit null)."""
    fx = Fixtures(spark, sf_dir)
    p = fx.projects_tbl
    patches = p.select("id", (F.col("id") % 2 == 0).alias("has_name"), F.upper("name").alias("name"),
                       (F.col("id") % 3 == 0).alias("has_domain"), F.lit(None).cast("string").alias("domain"))
    patches = patches.filter(F.col("has_name") | F.col("has_domain"))
    return catalog.apply_patches(p, patches)


@register("integrity_audit", O.with_fx("""SELECT 'unique_project_url' AS check_name, 'pages' AS table_name, count(*) AS n_violations FROM (
     SELECT project_id, url FROM fx_pages GROUP BY project_id, url HAVING count(*)>1)
   UNION ALL SELECT 'fk_project_id', 'project_configs', count(*) FROM fx_project_configs WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM fx_projects_tbl)
   UNION ALL SELECT 'fk_project_id', 'webhooks', count(*) FROM fx_webhooks WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM fx_projects_tbl)
   UNION ALL SELECT 'fk_project_id', 'runs', count(*) FROM fx_runs WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM fx_projects_tbl)
   UNION ALL SELECT 'fk_page_id', 'page_revisions', count(*) FROM fx_revisions WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT id FROM fx_pages)
   UNION ALL SELECT 'fk_webhook_id', 'webhook_events', count(*) FROM fx_webhook_events WHERE webhook_id IS NOT NULL AND webhook_id NOT IN (SELECT id FROM fx_webhooks)
   UNION ALL SELECT 'fk_current_revision_id', 'pages', count(*) FROM fx_pages WHERE current_revision_id IS NOT NULL AND current_revision_id NOT IN (SELECT id FROM fx_revisions)
   UNION ALL SELECT 'fk_run_id', 'artifacts', count(*) FROM fx_artifacts WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT id FROM fx_runs)
   UNION ALL SELECT 'enum_status', 'runs', count(*) FROM fx_runs WHERE status IS NULL OR status NOT IN ('QUEUED','IN_PROGRESS','COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS','FAILED','RETRYING')
   UNION ALL SELECT 'enum_type', 'artifacts', count(*) FROM fx_artifacts WHERE type IS NULL OR type NOT IN ('LLMS_TXT','JSON','OTHER')
   UNION ALL SELECT 'not_null_name', 'projects', count(*) FROM fx_projects_tbl WHERE name IS NULL
   UNION ALL SELECT 'not_null_domain', 'projects', count(*) FROM fx_projects_tbl WHERE domain IS NULL
   UNION ALL SELECT 'not_null_url', 'pages', count(*) FROM fx_pages WHERE url IS NULL
   UNION ALL SELECT 'not_null_url', 'webhooks', count(*) FROM fx_webhooks WHERE url IS NULL
   UNION ALL SELECT 'not_null_status', 'runs', count(*) FROM fx_runs WHERE status IS NULL"""))
def q_integrity_audit(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    t = _tables(fx)
    t["pages"] = fx.pages
    t["page_revisions"] = fx.revisions
    return catalog.integrity_audit(t, skip=("pages.project_id",))
