"""Registered queries of the read model: W3a W3b J9 P27 W4 P21 J8 J6 F4 J4 J5
J7 F9 L1 P19 P20 P26 A5 A6 W5 W6 F6 F7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import catalog, runs, webhooks
from . import oracle as O
from .fixtures import Fixtures
from .queries import FIXED_NOW, register


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


ART_COLS = "id, run_id, type, public_url, storage_path, created_at"


@register("latest_artifact_by_project", O.with_fx(
    f"""SELECT project_id, {ART_COLS} FROM (SELECT a.*, r.project_id, row_number() OVER (PARTITION BY r.project_id
    ORDER BY a.created_at DESC, a.id DESC) AS rn FROM fx_artifacts a JOIN fx_runs r ON r.id=a.run_id WHERE a.type='LLMS_TXT') WHERE rn=1"""))
def q_latest_artifact_by_project(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return catalog.latest_artifact_by_project(fx.artifacts, fx.runs).select("project_id", *[c.strip() for c in ART_COLS.split(",")])


@register("latest_artifact_by_run", O.with_fx(
    f"""SELECT {ART_COLS} FROM (SELECT a.*, row_number() OVER (PARTITION BY a.run_id ORDER BY a.created_at DESC, a.id DESC) AS rn
    FROM fx_artifacts a WHERE a.type='LLMS_TXT') WHERE rn=1"""))
def q_latest_artifact_by_run(spark, sf_dir):
    return catalog.latest_artifact_by_run(_fx(spark, sf_dir).artifacts).select(*[c.strip() for c in ART_COLS.split(",")])


def _placeholder_sql(project, run, status):
    return (f"concat('Site: ', CAST({project} AS VARCHAR), chr(10), 'Generated-At: 2024-03-15T12:00:00.000Z', chr(10), 'Status: ', {status}, "
            "chr(10), chr(10), '[Note]', chr(10), 'This is a placeholder llms.txt file. The actual generated content will be available once the worker processes this run.', "
            f"chr(10), chr(10), 'Run ID: ', CAST({run} AS VARCHAR), chr(10), 'Project ID: ', CAST({project} AS VARCHAR), chr(10))")


@register("run_artifact", O.with_fx(
    f"""WITH la AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.run_id ORDER BY a.created_at DESC, a.id DESC) AS rn
    FROM fx_artifacts a WHERE a.type='LLMS_TXT') WHERE rn=1)
    SELECT r.id AS run_id, r.project_id, r.status, la.id AS artifact_id,
      CASE WHEN la.run_id IS NULL THEN 'not_found' WHEN coalesce(la.public_url,'')<>'' THEN 'redirect'
           WHEN coalesce(la.storage_path,'')<>'' THEN 'pointer' ELSE 'placeholder' END AS delivery_kind,
      CASE WHEN la.run_id IS NULL THEN NULL WHEN coalesce(la.public_url,'')<>'' THEN la.public_url
           WHEN coalesce(la.storage_path,'')<>'' THEN la.storage_path ELSE {_placeholder_sql('r.project_id', 'r.id', 'r.status')} END AS delivery_value
    FROM fx_runs r LEFT JOIN la ON la.run_id=r.id WHERE r.status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS')"""))
def q_run_artifact(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return catalog.run_artifact(fx.runs, fx.artifacts, FIXED_NOW)


@register("latest_webhook_event", O.with_fx(
    """SELECT webhook_id, id, attempted_at, status_code FROM (SELECT *, row_number() OVER (PARTITION BY webhook_id
    ORDER BY attempted_at DESC, id DESC) AS rn FROM fx_webhook_events) WHERE rn=1"""))
def q_latest_webhook_event(spark, sf_dir):
    return webhooks.latest_event(_fx(spark, sf_dir).webhook_events)


@register("webhook_status", O.with_fx(
    """WITH le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY attempted_at DESC, id DESC) AS rn
    FROM fx_webhook_events) WHERE rn=1)
    SELECT w.id AS webhook_id, w.project_id, le.attempted_at AS last_attempted_at, le.status_code AS last_status_code,
      CASE WHEN le.attempted_at IS NULL THEN 'Not run yet' ELSE strftime(le.attempted_at, '%Y-%m-%d %H:%M:%S') END AS last_attempted,
      CASE WHEN le.attempted_at IS NULL THEN NULL WHEN le.status_code>=200 AND le.status_code<300 THEN 'Success'
           WHEN le.status_code>=400 THEN 'Failure' END AS outcome
    FROM fx_webhooks w LEFT JOIN le ON le.webhook_id=w.id"""))
def q_webhook_status(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return webhooks.webhook_status(fx.webhooks, fx.webhook_events)


@register("delivery_outcome", O.with_fx(
    """SELECT id, status_code, CASE WHEN status_code>=200 AND status_code<300 THEN 'Success' WHEN status_code>=400 THEN 'Failure' END AS outcome
    FROM fx_webhook_events"""))
def q_delivery_outcome(spark, sf_dir):
    ev = _fx(spark, sf_dir).webhook_events
    return ev.select("id", "status_code", labels.delivery_outcome("status_code").alias("outcome"))


@register("project_webhook_events", O.with_fx(
    "SELECT e.*, w.project_id FROM fx_webhook_events e JOIN fx_webhooks w ON w.id=e.webhook_id"))
def q_project_webhook_events(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return webhooks.project_events(fx.webhook_events, fx.webhooks)


@register("webhook_owner_check", O.with_fx(
    "SELECT w.*, p.created_by AS owner FROM fx_webhooks w JOIN fx_projects_tbl p ON p.id=w.project_id"))
def q_webhook_owner_check(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return webhooks.owned_webhooks(fx.webhooks, fx.projects_tbl)


@register("active_webhooks", O.with_fx("SELECT * FROM fx_webhooks WHERE is_active"))
def q_active_webhooks(spark, sf_dir):
    return webhooks.active_webhooks(_fx(spark, sf_dir).webhooks)


@register("config_with_domain", O.with_fx(
    "SELECT c.*, p.domain FROM fx_project_configs c JOIN fx_projects_tbl p ON p.id=c.project_id"))
def q_config_with_domain(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return catalog.config_with_domain(fx.project_configs, fx.projects_tbl)


@register("projects_with_config", O.with_fx(
    """SELECT p.*, c.crawl_depth AS cfg_crawl_depth, c.cron_expression AS cfg_cron_expression, c.is_enabled AS cfg_is_enabled,
    c.project_id IS NOT NULL AS has_config FROM fx_projects_tbl p LEFT JOIN fx_project_configs c ON c.project_id=p.id"""))
def q_projects_with_config(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    j = catalog.projects_with_config(fx.projects_tbl, fx.project_configs)
    return j.select("id", "created_by", "name", "domain",
                    F.col("project_configs.crawl_depth").alias("cfg_crawl_depth"),
                    F.col("project_configs.cron_expression").alias("cfg_cron_expression"),
                    F.col("project_configs.is_enabled").alias("cfg_is_enabled"),
                    F.col("project_configs").isNotNull().alias("has_config"))


@register("owned_runs", O.with_fx(
    "SELECT r.*, p.created_by AS owner FROM fx_runs r JOIN fx_projects_tbl p ON p.id=r.project_id"))
def q_owned_runs(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return catalog.owned_runs(fx.runs, fx.projects_tbl)


ASKING = (3, 7, 11)     # users who ask, one after the other


def _asked(read):
    """What ``read(user)`` returns for each asking user."""
    out = None
    for user in ASKING:
        part = read(user).withColumn("asking", F.lit(user).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


@register("owner_scope", O.with_fx(f"SELECT *, created_by AS asking FROM fx_projects_tbl WHERE created_by IN {ASKING}"))
def q_owner_scope(spark, sf_dir):
    """each asking user's projects."""
    projects = _fx(spark, sf_dir).projects_tbl
    return _asked(lambda user: catalog.owner_scope(projects, user))


@register("owned_runs_by_user", O.with_fx(
    f"SELECT r.*, p.created_by AS asking FROM fx_runs r JOIN fx_projects_tbl p ON p.id=r.project_id WHERE p.created_by IN {ASKING}"))
def q_owned_runs_by_user(spark, sf_dir):
    """J7 as a user asks for it."""
    fx = _fx(spark, sf_dir)
    return _asked(lambda user: catalog.owned_runs(fx.runs, fx.projects_tbl, user))


@register("webhook_owner_check_by_user", O.with_fx(f"""SELECT w.*, p.created_by AS owner, p.created_by AS asking
   FROM fx_webhooks w JOIN fx_projects_tbl p ON p.id=w.project_id WHERE p.created_by IN {ASKING}"""))
def q_webhook_owner_check_by_user(spark, sf_dir):
    """J6 as a user asks for it."""
    fx = _fx(spark, sf_dir)
    return _asked(lambda user: webhooks.owned_webhooks(fx.webhooks, fx.projects_tbl, user))


@register("owned_by_counts", O.with_fx(
    """SELECT p.created_by AS owner, count(*) AS n_projects, count(c.project_id) AS n_configured
    FROM fx_projects_tbl p LEFT JOIN fx_project_configs c ON c.project_id=p.id GROUP BY p.created_by"""))
def q_owned_by_counts(spark, sf_dir):
    """What each owner's scope holds."""
    fx = _fx(spark, sf_dir)
    j = catalog.projects_with_config(fx.projects_tbl, fx.project_configs)
    return j.groupBy(F.col("created_by").alias("owner")).agg(
        F.count(F.lit(1)).alias("n_projects"), F.count("project_configs").alias("n_configured"))


@register("list_newest_first", O.with_fx("SELECT id, project_id, status, created_at FROM fx_runs ORDER BY created_at DESC, id DESC"))
def q_list_newest_first(spark, sf_dir):
    return catalog.newest_first(_fx(spark, sf_dir).runs).select("id", "project_id", "status", "created_at")


@register("schedule_label", O.with_fx(
    """SELECT project_id, cron_expression, CASE WHEN coalesce(cron_expression,'')='' THEN 'None' WHEN cron_expression='0 2 * * *' THEN 'Daily'
    WHEN cron_expression='0 2 * * 0' THEN 'Weekly' ELSE 'Custom' END AS schedule_label FROM fx_project_configs"""))
def q_schedule_label(spark, sf_dir):
    c = _fx(spark, sf_dir).project_configs
    return c.select("project_id", "cron_expression", labels.schedule_label("cron_expression").alias("schedule_label"))


@register("status_label", O.with_fx(
    """SELECT id, status, CASE status WHEN 'COMPLETE_WITH_DIFFS' THEN 'Changes Detected' WHEN 'COMPLETE_NO_DIFFS' THEN 'No Changes'
    WHEN 'IN_PROGRESS' THEN 'In Progress' WHEN 'FAILED' THEN 'Failed' WHEN 'RETRYING' THEN 'Retrying' WHEN 'QUEUED' THEN 'Queued'
    ELSE status END AS status_label FROM fx_runs"""))
def q_status_label(spark, sf_dir):
    r = _fx(spark, sf_dir).runs
    return r.select("id", "status", labels.status_label("status").alias("status_label"))


@register("effective_time", O.with_fx("SELECT id, coalesce(finished_at, created_at) AS effective_at FROM fx_runs"))
def q_effective_time(spark, sf_dir):
    return _fx(spark, sf_dir).runs.select("id", labels.effective_time().alias("effective_at"))


@register("has_active_run", O.with_fx(
    "SELECT project_id, bool_or(status='IN_PROGRESS') AS has_active_run FROM fx_runs GROUP BY project_id"))
def q_has_active_run(spark, sf_dir):
    return runs.has_active_run(_fx(spark, sf_dir).runs)


@register("last_run_at", O.with_fx(
    """SELECT project_id, max(finished_at) AS last_run_at FROM fx_runs WHERE status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS','FAILED')
    GROUP BY project_id"""))
def q_last_run_at(spark, sf_dir):
    return runs.last_run_at(_fx(spark, sf_dir).runs)


@register("last_complete_run", O.with_fx(
    """SELECT project_id, id, status, created_at, finished_at, is_scheduled, effective_at FROM (SELECT *, coalesce(finished_at, created_at) AS effective_at,
    row_number() OVER (PARTITION BY project_id ORDER BY coalesce(finished_at, created_at) DESC, id DESC) AS rn
    FROM fx_runs WHERE status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS')) WHERE rn=1"""))
def q_last_complete_run(spark, sf_dir):
    return runs.last_complete_run(_fx(spark, sf_dir).runs)


@register("index_history", O.with_fx(
    """SELECT id, project_id, status, created_at, finished_at, is_scheduled, coalesce(finished_at, created_at) AS effective_at,
    row_number() OVER (PARTITION BY project_id ORDER BY coalesce(finished_at, created_at) DESC, id DESC) AS position,
    row_number() OVER (PARTITION BY project_id ORDER BY coalesce(finished_at, created_at) DESC, id DESC) = 1 AS is_latest
    FROM fx_runs WHERE status='COMPLETE_WITH_DIFFS'"""))
def q_index_history(spark, sf_dir):
    return runs.index_history(_fx(spark, sf_dir).runs)


@register("active_runs", O.with_fx("SELECT * FROM fx_runs WHERE status IN ('QUEUED','IN_PROGRESS')"))
def q_active_runs(spark, sf_dir):
    return runs.active_runs(_fx(spark, sf_dir).runs)


@register("completed_runs", O.with_fx("SELECT * FROM fx_runs WHERE status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS')"))
def q_completed_runs(spark, sf_dir):
    return runs.completed_runs(_fx(spark, sf_dir).runs)
