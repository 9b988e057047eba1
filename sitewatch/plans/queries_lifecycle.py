"""Registered queries of the run lifecycle and notifications: R1-R5, J11,
P16-P18, P22-P25, P28, S5, S11, S12, A7, F5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, schedule, urls, variants
from ..operators import catalog, runs, webhooks
from ..sources import jobs as jobsrc
from . import oracle as O
from .fixtures import Fixtures
from .queries import FIXED_NOW, FIXED_NOW_ISO, PUBLIC_BASE, SITE_INDEX_MAX_PAGES, crawl_job, register
from .queries_crawl import site_index_ctes

NOW_SQL = f"TIMESTAMP '{FIXED_NOW}'"


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def duck_two_am(n: str) -> str:
    return f"(date_trunc('day', {n}) + INTERVAL 2 HOUR)"


def duck_next_daily(n: str) -> str:
    t = duck_two_am(n)
    return f"(CASE WHEN {t} <= {n} THEN {t} + INTERVAL 1 DAY ELSE {t} END)"


def duck_next_weekly(n: str, api: bool = False) -> str:
    t = duck_two_am(n)
    d = f"((7 - dayofweek({n})) % 7)"
    days = f"(CASE WHEN {d}=0 THEN 7 ELSE {d} END)" if api else f"(CASE WHEN {d}=0 AND {t} <= {n} THEN 7 ELSE {d} END)"
    return f"({t} + to_days(CAST({days} AS INTEGER)))"


# --- R1 -----------------------------------------------------------------------
@register("run_transition", O.with_fx(f"""SELECT id, project_id, CASE WHEN id%4=1 THEN 'IN_PROGRESS' ELSE status END AS status, created_at,
  CASE WHEN status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS','FAILED') THEN coalesce(finished_at, {NOW_SQL}) END AS finished_at,
  CASE WHEN status='FAILED' THEN CASE WHEN is_scheduled THEN 'Generation failed: scheduled run' ELSE 'Generation failed' END
       WHEN status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS') AND is_scheduled THEN 'scheduled run' END AS summary,
  {NOW_SQL} AS updated_at FROM fx_runs"""))
def q_run_transition(spark, sf_dir):
    r = _fx(spark, sf_dir).runs
    base = r.select("id", "project_id", F.lit("QUEUED").alias("status"), "created_at",
                    F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("summary"),
                    F.lit(None).cast("timestamp").alias("updated_at"))
    changes = r.select(F.col("id").alias("run_id"), "status",
                       F.when(F.col("is_scheduled"), F.lit("scheduled run")).alias("summary"),
                       "finished_at", F.lit(1).alias("seq"))
    # every run was in progress before, and some are again afterwards
    again = changes.select("run_id", F.lit("IN_PROGRESS").alias("status"), F.lit("started").alias("summary"),
                           F.lit(None).cast("timestamp").alias("finished_at"),
                           F.explode(F.when(F.col("run_id") % 4 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("seq"))
    return runs.apply_transitions(base, changes.unionByName(again), FIXED_NOW)


# --- R2 / J11 / P24 ---------------------------------------------------------------
def _actions(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    r = fx.runs
    first = r.groupBy("project_id").agg(F.min(F.struct("created_at", "id")).alias("_first"))
    r = (r.join(first, "project_id")
         .withColumn("is_initial", F.struct("created_at", "id") == F.col("_first")).drop("_first"))
    latest = catalog.latest_artifact_by_project(fx.artifacts, fx.runs).select(
        "project_id", F.col("public_url").alias("latest_url"))
    return runs.completion_actions(r, latest), fx


ACTIONS_SQL = ("fx_actions", """SELECT r.id AS run_id, r.project_id, r.status,
   (r.status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS','FAILED') AND r.project_id IS NOT NULL) AS touch_last_run,
   (r.status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS') AND r.project_id IS NOT NULL AND (r.is_scheduled OR r.id = fr.first_id)) AS schedule_next,
   (r.status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS') AND r.project_id IS NOT NULL AND coalesce(la.public_url,'')<>''
     AND (NOT r.is_scheduled OR r.status='COMPLETE_WITH_DIFFS')) AS notify,
   CASE WHEN r.status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS') AND r.project_id IS NOT NULL THEN la.public_url END AS notify_url
   FROM fx_runs r
   LEFT JOIN (SELECT project_id, id AS first_id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS rn FROM fx_runs) WHERE rn=1) fr ON fr.project_id=r.project_id
   LEFT JOIN (SELECT project_id, public_url FROM (SELECT a.*, r2.project_id, row_number() OVER (PARTITION BY r2.project_id ORDER BY a.created_at DESC, a.id DESC) AS rn
      FROM fx_artifacts a JOIN fx_runs r2 ON r2.id=a.run_id WHERE a.type='LLMS_TXT') WHERE rn=1) la ON la.project_id=r.project_id""")


@register("completion_actions", O.with_fx("SELECT * FROM fx_actions", ACTIONS_SQL))
def q_completion_actions(spark, sf_dir):
    return _actions(spark, sf_dir)[0]


@register("notification_fanout", O.with_fx(f"""SELECT a.run_id, a.project_id, w.id AS webhook_id, w.url AS webhook_url, 'run.complete' AS event_type,
   json_object('created_at', '{FIXED_NOW_ISO}', 'llms_txt_url', a.notify_url)::VARCHAR AS payload,
   '{{"Content-Type":"application/json","User-Agent":"llmstxt-crawler/1.0"}}' AS headers_json
   FROM fx_actions a JOIN fx_webhooks w ON w.project_id=a.project_id WHERE a.notify AND w.is_active""", ACTIONS_SQL))
def q_notification_fanout(spark, sf_dir):
    actions, fx = _actions(spark, sf_dir)
    out = webhooks.fanout(actions, fx.webhooks, FIXED_NOW)
    return out.withColumn("headers_json", F.to_json("headers")).drop("headers")


# --- P25 / S11 ------------------------------------------------------------------
@register("webhook_event_append", """SELECT event_id AS id, user_id AS webhook_id, 'run.complete' AS event_type, props AS payload,
   CASE WHEN event_type IN ('error','signup') THEN NULL WHEN event_type='purchase' THEN 200 WHEN event_type='click' THEN 204 ELSE 302 END AS status_code,
   CASE WHEN event_type='error' THEN 'Request timeout' WHEN event_type='signup' THEN 'Connection refused'
        WHEN event_type='purchase' THEN substring(repeat(props, 120), 1, 1000) WHEN event_type='click' THEN NULL ELSE props END AS response_body,
   ts AS attempted_at FROM events""")
def q_webhook_event_append(spark, sf_dir):
    ev = _fx(spark, sf_dir).table("events")
    et = F.col("event_type")
    deliveries = ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("webhook_id"), F.col("props").alias("payload"),
        F.when(et == "purchase", 200).when(et == "click", 204).when(et == "signup", 404).otherwise(302).alias("status_code"),
        F.when(et == "purchase", F.repeat("props", 120)).when(et == "click", F.lit("")).otherwise(F.col("props")).alias("body"),
        F.when(et == "error", F.lit("timeout")).when(et == "signup", F.lit("error")).alias("error_kind"),
        F.when(et == "signup", F.lit("Connection refused")).alias("error_message"),
        F.col("ts").cast("timestamp").alias("attempted_at"))
    return webhooks.event_rows(deliveries)


# --- R3 ---------------------------------------------------------------------------
@register("job_outcome", O.with_fx(f"""SELECT 'job_' || s.project_id AS job_id, 'run_' || s.project_id AS run_id, s.project_id,
   CASE WHEN coalesce(m.has_changes,false) THEN 'COMPLETE_WITH_DIFFS' ELSE 'COMPLETE_NO_DIFFS' END AS status,
   CASE WHEN coalesce(m.has_changes,false) THEN d.document END AS document,
   CASE WHEN coalesce(m.has_changes,false) THEN '{PUBLIC_BASE}/llms-txt/llms_job_' || s.project_id || '.txt' END AS llms_txt_url,
   CASE WHEN coalesce(m.has_changes,false) THEN 'Successfully generated llms.txt file. Artifact: {PUBLIC_BASE}/llms-txt/llms_job_' || s.project_id || '.txt'
        ELSE 'No changes detected, skipping generation' END AS summary
   FROM fx_projects s LEFT JOIN fx_summary m ON m.project_id=s.project_id LEFT JOIN fx_documents d ON d.project_id=s.project_id""",
    *site_index_ctes(SITE_INDEX_MAX_PAGES)))
def q_job_outcome(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    return runs.job_outcome(job.turn.select("project_id", "job_id", "run_id"), None, job.documents, PUBLIC_BASE)


# --- scheduling ---------------------------------------------------------------------
SCHED_SQL = ("fx_sched", f"""SELECT * FROM (SELECT c.project_id, c.cron_expression, c.is_enabled, c.crawl_depth, p.domain,
   CASE c.cron_expression WHEN '0 2 * * *' THEN {duck_next_daily(NOW_SQL)} WHEN '0 2 * * 0' THEN {duck_next_weekly(NOW_SQL)} END AS next_run_at
   FROM fx_project_configs c JOIN fx_projects_tbl p ON p.id=c.project_id)
   WHERE coalesce(is_enabled,false) AND coalesce(cron_expression,'')<>'' AND next_run_at IS NOT NULL AND coalesce(domain,'')<>''""")


@register("schedulable_projects", O.with_fx("SELECT * FROM fx_sched", SCHED_SQL))
def q_schedulable_projects(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return runs.schedulable(fx.project_configs, fx.projects_tbl, FIXED_NOW)


def _duck_run_id(kind: str, project: str, at: str) -> str:
    return f"('run_' || sha256('{kind}|' || CAST({project} AS VARCHAR) || '|' || CAST(epoch_us({at}) AS VARCHAR)))"


@register("schedule_next", O.with_fx(f"""SELECT project_id, {_duck_run_id('scheduled', 'project_id', 'next_run_at')} AS run_id, 'QUEUED' AS status,
   {NOW_SQL} AS created_at, 'scheduled_' || CAST(project_id AS VARCHAR) || '_' || CAST(epoch_us(next_run_at) // 1000000 AS VARCHAR) AS job_id,
   json_object('id', 'scheduled_' || CAST(project_id AS VARCHAR) || '_' || CAST(epoch_us(next_run_at) // 1000000 AS VARCHAR), 'projectId', project_id,
     'url', domain, 'priority', 'scheduled', 'render_mode', 'scheduled', 'isScheduled', true, 'scheduledAt', epoch_us(next_run_at) // 1000,
     'runId', {_duck_run_id('scheduled', 'project_id', 'next_run_at')},
     'metadata', json_object('cron_expression', cron_expression, 'scheduled_by', 'worker'))::VARCHAR AS payload,
   {NOW_SQL} AS last_run_at, next_run_at FROM fx_sched""", SCHED_SQL))
def q_schedule_next(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return runs.schedule_next(fx.project_configs, fx.projects_tbl, FIXED_NOW)


@register("next_run_times", f"""SELECT event_id, ts AS now_ts, {duck_next_daily('ts')} AS next_daily, {duck_next_weekly('ts')} AS next_weekly,
   {duck_next_weekly('ts', api=True)} AS next_weekly_api FROM events""")
def q_next_run_times(spark, sf_dir):
    ev = _fx(spark, sf_dir).table("events").select("event_id", F.col("ts").cast("timestamp").alias("now_ts"))
    return ev.select("event_id", "now_ts", schedule.next_run_daily("now_ts").alias("next_daily"),
                     schedule.next_run_weekly("now_ts").alias("next_weekly"),
                     schedule.next_run_weekly_api("now_ts").alias("next_weekly_api"))


@register("schedule_to_cron", f"""SELECT c_custkey AS project_id, s AS schedule,
   CASE s WHEN 'daily' THEN '0 2 * * *' WHEN 'weekly' THEN '0 2 * * 0' END AS cron_expression,
   CASE s WHEN 'daily' THEN {duck_next_daily(NOW_SQL)} WHEN 'weekly' THEN {duck_next_weekly(NOW_SQL, api=True)} END AS next_run_at
   FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'daily' WHEN 'MACHINERY' THEN 'weekly' WHEN 'FURNITURE' THEN 'custom'
   ELSE lower(c_mktsegment) END AS s FROM customer)""")
def q_schedule_to_cron(spark, sf_dir):
    c = _fx(spark, sf_dir).table("customer")
    seg = F.col("c_mktsegment")
    s = (F.when(seg == "BUILDING", "daily").when(seg == "MACHINERY", "weekly").when(seg == "FURNITURE", "custom")
         .otherwise(F.lower(seg)))
    c = c.select(F.col("c_custkey").alias("project_id"), s.alias("schedule"))
    cron, nxt = schedule.schedule_to_cron("schedule", F.lit(FIXED_NOW).cast("timestamp"))
    return c.select("project_id", "schedule", cron.alias("cron_expression"), nxt.alias("next_run_at"))


# --- R5 / S12 ---------------------------------------------------------------------------
@register("initial_runs", O.with_fx(f"""SELECT project_id, run_id, initiated_by, 'QUEUED' AS status, {NOW_SQL} AS created_at,
   'job_' || sha256(run_id) AS job_id,
   json_object('id', 'job_' || sha256(run_id), 'url', domain, 'projectId', project_id, 'runId', run_id, 'priority', 'NORMAL',
     'render_mode', 'STATIC', 'isScheduled', false, 'isInitialRun', true)::VARCHAR AS payload
   FROM (SELECT p.id AS project_id, p.created_by AS initiated_by, p.domain, {_duck_run_id('initial', 'p.id', NOW_SQL)} AS run_id
     FROM fx_projects_tbl p JOIN fx_project_configs c ON c.project_id=p.id WHERE coalesce(c.is_enabled, true))"""))
def q_initial_runs(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return runs.initial_runs(fx.projects_tbl, fx.project_configs, FIXED_NOW)


@register("run_insert", O.with_fx(f"""SELECT {_duck_run_id('manual', 'id', NOW_SQL)} AS id, id AS project_id, created_by AS initiated_by,
   'QUEUED' AS status, 'Generation run for ' || domain AS summary, {NOW_SQL} AS created_at, '{{}}' AS metrics FROM fx_projects_tbl"""))
def q_run_insert(spark, sf_dir):
    p = _fx(spark, sf_dir).projects_tbl
    req = p.select(F.col("id").alias("project_id"), F.col("created_by").alias("initiated_by"), F.col("domain").alias("url"))
    return runs.create_runs(req, FIXED_NOW)


# --- P28 / P22 -------------------------------------------------------------------------------
@register("fill_defaults", O.with_fx("""SELECT id, project_id, url, is_active, 'run.complete' AS event_types FROM fx_webhooks"""))
def q_fill_defaults(spark, sf_dir):
    wh = _fx(spark, sf_dir).webhooks
    out = catalog.fill_defaults(wh, "webhook")
    return out.select("id", "project_id", "url", "is_active", F.array_join("event_types", ",").alias("event_types"))


@register("fill_defaults_project", O.with_fx("""SELECT id, name, 2 AS crawl_depth, CASE WHEN id%3=0 THEN 'weekly' ELSE 'daily' END AS cron_expression,
   id%2=0 AS is_enabled, '{}' AS metadata FROM fx_projects_tbl"""))
def q_fill_defaults_project(spark, sf_dir):
    p = _fx(spark, sf_dir).projects_tbl
    given = p.select("id", "name", F.when(F.col("id") % 3 == 0, "weekly").alias("cron_expression"),
                     F.when(F.col("id") % 2 != 0, F.lit(False)).alias("is_enabled"))
    return catalog.fill_defaults(given, "project").select("id", "name", "crawl_depth", "cron_expression", "is_enabled", "metadata")


@register("fill_defaults_run_request", O.with_fx("""SELECT id, CASE WHEN id%5=0 THEN 'HIGH' ELSE 'NORMAL' END AS priority,
   'STATIC' AS render_mode, CASE WHEN is_scheduled THEN '{"by":"timer"}' ELSE '{}' END AS metadata FROM fx_runs"""))
def q_fill_defaults_run_request(spark, sf_dir):
    r = _fx(spark, sf_dir).runs
    given = r.select("id", F.when(F.col("id") % 5 == 0, "HIGH").alias("priority"), F.when(F.col("is_scheduled"), '{"by":"timer"}').alias("metadata"))
    return catalog.fill_defaults(given, "run_request").select("id", "priority", "render_mode", "metadata")


VALID_URL_DUCK = r"(?i)^https?://(?:[^\s/?#@]*@)?(?:\[[0-9a-f:.]+\]|[^\s/?#@:\[\]]+)(:[0-9]*)?([/?#][^\s]*)?$"


@register("validate_domain", f"""SELECT id, name, domain AS domain_input, norm AS domain,
   (coalesce(name,'')<>'' AND coalesce(domain,'')<>'' AND regexp_matches(norm, '{VALID_URL_DUCK}')) AS is_valid,
   CASE WHEN coalesce(name,'')='' OR coalesce(domain,'')='' THEN 'Name and domain are required'
        WHEN NOT regexp_matches(norm, '{VALID_URL_DUCK}') THEN 'Invalid domain URL' END AS reject_reason,
   regexp_matches(norm, '^https?:\\/\\/(www\\.)?[-a-zA-Z0-9@:%._\\+~#=]{{1,256}}\\.[a-zA-Z0-9()]{{1,6}}\\b([-a-zA-Z0-9()@:%_\\+.~#?&//=]*)$') AS form_ok
   FROM (SELECT id, name, domain, CASE WHEN domain LIKE 'http%' THEN domain ELSE 'https://' || domain END AS norm FROM (
     SELECT c_custkey AS id, CASE WHEN c_custkey%17=0 THEN '' ELSE c_name END AS name,
       CASE c_custkey%3 WHEN 0 THEN lower(replace(c_name,'#','-')) || '.example.com' WHEN 1 THEN 'http://' || lower(replace(c_name,'#','-')) || '.example.org/x?y=1'
       ELSE 'bad domain ' || c_name END AS domain FROM customer))""")
def q_validate_domain(spark, sf_dir):
    from ..operators.catalog import validate_projects
    c = _fx(spark, sf_dir).table("customer")
    k = F.col("c_custkey")
    slug = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
    cand = c.select(k.alias("id"), F.when(k % 17 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
                    F.when(k % 3 == 0, F.concat(slug, F.lit(".example.com")))
                     .when(k % 3 == 1, F.concat(F.lit("http://"), slug, F.lit(".example.org/x?y=1")))
                     .otherwise(F.concat(F.lit("bad domain "), F.col("c_name"))).alias("domain"))
    return validate_projects(cand).select("id", "name", F.col("domain_input"), "domain", "is_valid", "reject_reason", "form_ok")


@register("create_projects", f"""WITH asked AS (SELECT c_custkey AS id, c_nationkey AS created_by,
     CASE WHEN c_custkey%17=0 THEN '' ELSE c_name END AS name,
     CASE WHEN c_custkey%19=0 THEN 'bad domain' WHEN c_custkey%2=0 THEN 'http://site-' || c_custkey || '.example.org' ELSE 'site-' || c_custkey || '.example.com' END AS domain,
     CASE c_custkey%4 WHEN 0 THEN NULL WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'custom' END AS cron,
     CASE WHEN c_custkey%5=0 THEN false END AS enabled FROM customer),
   good AS (SELECT *, 'prj_' || sha256(CAST(id AS VARCHAR)) AS pid, coalesce(cron, 'daily') AS sched, coalesce(enabled, true) AS on_,
     CASE WHEN domain LIKE 'http%' THEN domain ELSE 'https://' || domain END AS norm FROM asked WHERE name <> '' AND domain <> 'bad domain')
   SELECT pid AS project_id, created_by, name, norm AS domain, 2 AS crawl_depth,
     CASE sched WHEN 'daily' THEN '0 2 * * *' WHEN 'weekly' THEN '0 2 * * 0' END AS cron_expression,
     CASE sched WHEN 'daily' THEN {duck_next_daily(NOW_SQL)} WHEN 'weekly' THEN {duck_next_weekly(NOW_SQL, api=True)} END AS next_run_at,
     on_ AS is_enabled, CASE WHEN on_ THEN 'QUEUED' END AS run_status, NULL::VARCHAR AS reject_reason FROM good
   UNION ALL SELECT CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
     CASE WHEN name='' THEN 'Name and domain are required' ELSE 'Invalid domain URL' END FROM asked WHERE name='' OR domain='bad domain'""")
def q_create_projects(spark, sf_dir):
    """Requests of every customer to projects, configurations and first runs; refused ones with their reason."""
    c = _fx(spark, sf_dir).table("customer")
    k = F.col("c_custkey")
    no = F.lit(None)
    asked = c.select(
        k.alias("request_id"), F.col("c_nationkey").alias("created_by"), F.when(k % 17 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 19 == 0, F.lit("bad domain")).when(k % 2 == 0, F.concat(F.lit("http://site-"), k.cast("string"), F.lit(".example.org")))
         .otherwise(F.concat(F.lit("site-"), k.cast("string"), F.lit(".example.com"))).alias("domain"), no.cast("string").alias("description"),
        F.when(k % 4 == 0, no).when(k % 4 == 1, "daily").when(k % 4 == 2, "weekly").otherwise("custom").alias("cron_expression"),
        F.when(k % 5 == 0, F.lit(False)).alias("is_enabled"))
    t = runs.create_projects(asked, FIXED_NOW)
    made = (t["projects"].select(F.col("id").alias("project_id"), "created_by", "name", "domain")
            .join(t["configs"].select("project_id", "crawl_depth", "cron_expression", "next_run_at", "is_enabled"), "project_id")
            .join(t["runs"].select("project_id", F.col("status").alias("run_status")), "project_id", "left")
            .withColumn("reject_reason", no.cast("string")))
    refused = t["rejected"].select(F.col("request_id").cast("string").alias("project_id"), "reject_reason")
    return made.unionByName(refused, allowMissingColumns=True)


# --- S5 / A7 ------------------------------------------------------------------------------------
def _raw_jobs(spark, sf_dir):
    r = _fx(spark, sf_dir).runs
    i = F.col("id")
    payload = F.to_json(F.struct(
        F.when(i % 7 != 0, F.concat(F.lit("job_"), i.cast("string"))).alias("id"),
        F.when(i % 11 != 0, F.concat(F.lit("https://site-"), F.col("project_id").cast("string"), F.lit(".example.com"))).alias("url"),
        F.when(i % 13 != 0, F.col("project_id")).alias("projectId"),
        F.when(i % 17 != 0, i.cast("string")).alias("runId"),
        F.when(i % 2 == 0, F.col("is_scheduled")).alias("isScheduled")))
    return r.select(i.alias("arrival"), payload.alias("value"))


@register("job_intake", """SELECT id AS arrival, CASE WHEN id%7<>0 THEN 'job_' || CAST(id AS VARCHAR) END AS id,
   CASE WHEN id%11<>0 THEN 'https://site-' || CAST(project_id AS VARCHAR) || '.example.com' END AS url,
   CASE WHEN id%13<>0 THEN CAST(project_id AS VARCHAR) END AS projectId, CASE WHEN id%17<>0 THEN CAST(id AS VARCHAR) END AS runId,
   CASE WHEN id%2=0 THEN is_scheduled ELSE false END AS isScheduled, false AS isInitialRun,
   (id%7<>0 AND id%11<>0 AND id%13<>0 AND id%17<>0) AS accepted,
   CASE WHEN NOT (id%7<>0 AND id%11<>0 AND id%13<>0 AND id%17<>0) THEN 'job must contain id+url+project id+run id' END AS reject_reason
   FROM (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderkey%3=0 AS is_scheduled FROM orders)""")
def q_job_intake(spark, sf_dir):
    return jobsrc.parse_jobs(_raw_jobs(spark, sf_dir)).drop("scheduledAt")


@register("queue_dedup", """SELECT runId, arrival, id FROM (SELECT runId, arrival, id, row_number() OVER (PARTITION BY runId ORDER BY arrival) AS rn FROM (
   SELECT o_orderkey AS arrival, 'job_' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS runId FROM orders
   WHERE o_orderkey%7<>0 AND o_orderkey%11<>0 AND o_orderkey%13<>0 AND o_orderkey%17<>0)) WHERE rn=1""")
def q_queue_dedup(spark, sf_dir):
    """Jobs re-keyed so that every run id arrives many times (one per order
    of the customer); the earliest arrival wins."""
    r = _fx(spark, sf_dir).runs
    i = F.col("id")
    raw = r.select(i.alias("arrival"), F.to_json(F.struct(
        F.when(i % 7 != 0, F.concat(F.lit("job_"), i.cast("string"))).alias("id"),
        F.when(i % 11 != 0, F.concat(F.lit("https://site-"), F.col("project_id").cast("string"), F.lit(".example.com"))).alias("url"),
        F.when(i % 13 != 0, F.col("project_id")).alias("projectId"),
        F.when(i % 17 != 0, F.col("project_id").cast("string")).alias("runId"))).alias("value"))
    ok = jobsrc.accepted_jobs(jobsrc.parse_jobs(raw))
    return jobsrc.dedup_jobs(ok.select("runId", "arrival", "id"), ["arrival"])


@register("job_metadata", """SELECT id AS arrival, CASE WHEN id%4=0 THEN 'daily' END AS cron, CASE WHEN id%4=0 THEN id%7 END AS retries,
   CASE WHEN id%4=1 THEN 'tag' || CAST(id%3 AS VARCHAR) END AS first_tag, id%4<2 AS has_metadata
   FROM (SELECT o_orderkey AS id FROM orders)""")
def q_job_metadata(spark, sf_dir):
    """Payloads with free metadata of several shapes, with none, and such that are no JSON."""
    i = F.col("id")
    text = (F.when(i % 4 == 0, F.to_json(F.struct(F.lit("daily").alias("cron"), F.struct((i % 7).alias("retries")).alias("queue"))))
            .when(i % 4 == 1, F.to_json(F.array(F.concat(F.lit("tag"), (i % 3).cast("string")), F.lit("x")))))
    value = F.when(i % 4 == 3, F.lit("{")).when(text.isNull(), F.lit('{"id": "j"}')).otherwise(F.concat(F.lit('{"id": "j", "metadata": '), text, F.lit("}")))
    found = jobsrc.job_metadata(_fx(spark, sf_dir).runs.select(i.alias("arrival"), value.alias("value")))
    return found.select("arrival", variants.field("metadata", "$.cron").alias("cron"), variants.field("metadata", "$.queue.retries", "long").alias("retries"),
                        variants.field("metadata", "$[0]").alias("first_tag"), F.col("metadata").isNotNull().alias("has_metadata"))


@register("event_type_filter", """WITH w AS (SELECT DISTINCT user_id AS id, user_id%50 AS project_id, user_id%4<>0 AS is_active FROM events),
   t AS (SELECT DISTINCT event_type FROM events)
   SELECT e.event_id, e.event_type, w.id AS webhook_id FROM events e JOIN w ON w.project_id=e.user_id%50 AND w.is_active
   WHERE CASE w.id%3 WHEN 0 THEN e.event_type='run.complete' WHEN 1 THEN e.event_type IN ('click','error') ELSE e.event_type='purchase' END""")
def q_event_type_filter(spark, sf_dir):
    """Events of the sites to the webhooks that ask for their type."""
    fx = _fx(spark, sf_dir)
    kinds = (F.when(F.col("id") % 3 == 1, F.array(F.lit("click"), F.lit("error"), F.lit("click"))).when(F.col("id") % 3 == 2, F.array(F.lit("purchase"))))
    index = webhooks.subscriptions(fx.webhooks.withColumn("event_types", kinds))
    events = fx.table("events").select("event_id", "event_type", (F.col("user_id") % 50).alias("project_id"))
    return webhooks.notify(events, index).select("event_id", "event_type", "webhook_id")


# --- whole runs, two of a project in one batch ------------------------------------
def pipeline_tables(fx):
    """The tables of ``run_pipeline`` around the crawl fixtures."""
    from .pipeline import SiteTables
    none = F.lit(None)
    jobs = fx.all_jobs
    return jobs, SiteTables(
        pages=fx.pages, revisions=fx.revisions, snapshot=fx.fetch.select("project_id", "url", "status_code", "body"),
        sitemap_urls=fx.sitemap,
        runs=jobs.select(F.col("run_id").alias("id"), "project_id", F.lit("QUEUED").alias("status"),
                         F.lit("2024-03-14 00:00:00").cast("timestamp").alias("created_at"), none.cast("timestamp").alias("finished_at"),
                         none.cast("string").alias("summary"), none.cast("timestamp").alias("updated_at")),
        projects=fx.projects.select(F.col("project_id").alias("id"), F.col("start_url").alias("domain")),
        configs=fx.projects.select("project_id", F.when(F.length("project_id") % 3 != 1, F.lit("0 2 * * *")).alias("cron_expression"),
                                   F.lit(True).alias("is_enabled"), none.cast("timestamp").alias("last_run_at"),
                                   none.cast("timestamp").alias("next_run_at"), F.lit(2).alias("crawl_depth")),
        webhooks=fx.projects.select(F.concat(F.lit("wh_"), "project_id").alias("id"), "project_id",
                                    F.concat(F.lit("https://hook.example/"), "project_id").alias("url"),
                                    (F.length("project_id") % 5 != 0).alias("is_active")),
        artifacts=fx.projects.limit(0).select(F.lit("").alias("id"), "project_id", F.lit("").alias("type"), F.lit("").alias("public_url"),
                                              F.lit(None).cast("timestamp").alias("created_at")))


def second_turn(ctes):
    """The same CTEs over the pages as the first runs leave them."""
    import re
    rename = lambda x: re.sub(r"\bfx_(changes|summary|budget|crawled|doc_parts|documents)\b", r"fx_\1_2", x)
    changes = ("fx_changes_2", """SELECT c.* REPLACE (CASE WHEN k.url IS NULL THEN c.change_class ELSE 'unchanged' END AS change_class)
       FROM fx_changes c LEFT JOIN fx_crawled k ON k.project_id=c.project_id AND k.url=c.url""")
    summary = ("fx_summary_2", "SELECT project_id, bool_or(change_class IN ('changed','new')) AS has_changes FROM fx_changes_2 GROUP BY project_id")
    return [changes, summary, *((rename(n), rename(sql)) for n, sql in ctes)]


@register("run_pipeline", O.with_fx(f"""SELECT o.run_id, o.project_id, o.status,
   CASE WHEN o.document IS NULL THEN 'No changes detected, skipping generation'
        ELSE 'Successfully generated llms.txt file. Artifact: {PUBLIC_BASE}/llms-txt/llms_' || o.job_id || '.txt' END AS summary,
   {NOW_SQL} AS finished_at, o.document,
   CASE WHEN w.project_id IS NOT NULL AND (NOT o.scheduled OR o.document IS NOT NULL) THEN 1 ELSE 0 END AS notifications,
   {NOW_SQL} AS last_run_at, CASE WHEN length(o.project_id)%2=0 AND length(o.project_id)%3<>1 THEN {duck_next_daily(NOW_SQL)} END AS next_run_at
   FROM (SELECT 'run_' || s.project_id AS run_id, 'job_' || s.project_id AS job_id, s.project_id, false AS scheduled, d.document, d.document AS any_document,
           CASE WHEN d.document IS NULL THEN 'COMPLETE_NO_DIFFS' ELSE 'COMPLETE_WITH_DIFFS' END AS status
         FROM fx_projects s LEFT JOIN fx_documents d ON d.project_id=s.project_id
         UNION ALL SELECT 'run_' || s.project_id || '_2', 'job_' || s.project_id || '_2', s.project_id, true, d2.document, coalesce(d.document, d2.document),
           CASE WHEN d2.document IS NULL THEN 'COMPLETE_NO_DIFFS' ELSE 'COMPLETE_WITH_DIFFS' END
         FROM fx_projects s LEFT JOIN fx_documents d ON d.project_id=s.project_id LEFT JOIN fx_documents_2 d2 ON d2.project_id=s.project_id
         WHERE length(s.project_id)%2=0) o
   LEFT JOIN (SELECT project_id FROM fx_projects WHERE length(project_id)%5<>0) w ON w.project_id=o.project_id AND o.any_document IS NOT NULL""",
    *site_index_ctes(SITE_INDEX_MAX_PAGES), *second_turn(site_index_ctes(SITE_INDEX_MAX_PAGES))))
def q_run_pipeline(spark, sf_dir):
    """Two turns of runs; per run its row, document, notifications, and its project's times afterwards."""
    from .pipeline import run_pipeline
    jobs, tables = pipeline_tables(_fx(spark, sf_dir))
    done = run_pipeline(jobs, tables, FIXED_NOW, PUBLIC_BASE, SITE_INDEX_MAX_PAGES)
    notes = done.outbox.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ran = done.tables.runs.join(jobs.select(F.col("run_id").alias("id")), "id").select(
        F.col("id").alias("run_id"), "project_id", "status", "summary", "finished_at")
    return (ran.join(done.documents.select("run_id", "document"), "run_id", "left").join(notes, "run_id", "left")
            .join(done.tables.configs.select("project_id", "last_run_at", "next_run_at"), "project_id")
            .select("run_id", "project_id", "status", "summary", "finished_at", "document",
                    F.coalesce("n", F.lit(0)).alias("notifications"), "last_run_at", "next_run_at"))
