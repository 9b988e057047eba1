"""One registered query per scalar expression of the inventory that the larger
queries also use: P13 P14 P15 P16 P17 P23 P24 P25 P27 F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, payloads, schedule
from ..operators import index
from . import oracle as O
from .fixtures import Fixtures
from .queries import FIXED_NOW, FIXED_NOW_ISO, PUBLIC_BASE, SITE_INDEX_MAX_PAGES, crawl_job, register
from .queries_crawl import site_index_ctes
from .queries_lifecycle import duck_next_daily, duck_next_weekly


@register("utf8_size", O.with_fx("SELECT project_id, CAST(strlen(document) AS BIGINT) AS size_bytes, CAST(length(document) AS BIGINT) AS n_chars FROM fx_documents",
                                 *site_index_ctes(SITE_INDEX_MAX_PAGES)))
def q_utf8_size(spark, sf_dir):
    d = crawl_job(spark, sf_dir).documents
    return d.select("project_id", index.utf8_size("document").cast("bigint").alias("size_bytes"),
                    F.length("document").cast("bigint").alias("n_chars"))


@register("artifact_location", O.with_fx(f"""SELECT project_id, 'llms_job_' || project_id || '.txt' AS file_name,
   's3://llms-txt/llms_job_' || project_id || '.txt' AS storage_path, '{PUBLIC_BASE}/llms-txt/llms_job_' || project_id || '.txt' AS public_url
   FROM fx_projects"""))
def q_artifact_location(spark, sf_dir):
    jobs = Fixtures(spark, sf_dir).jobs
    name, path, public = index.artifact_location(F.col("job_id"), PUBLIC_BASE)
    return jobs.select("project_id", name.alias("file_name"), path.alias("storage_path"), public.alias("public_url"))


@register("run_summary", O.with_fx("""SELECT id, status, CASE WHEN status='FAILED' THEN CASE WHEN is_scheduled THEN 'Generation failed: scheduled run' ELSE 'Generation failed' END
   WHEN status IN ('COMPLETE_NO_DIFFS','COMPLETE_WITH_DIFFS') THEN 'Successfully generated llms.txt file. Artifact: https://store.example/public/llms-txt/llms_' || CAST(id AS VARCHAR) || '.txt'
   WHEN status='QUEUED' THEN 'Generation run for https://site-' || CAST(project_id AS VARCHAR) || '.example.com'
   WHEN is_scheduled THEN 'scheduled run' END AS summary FROM fx_runs"""))
def q_run_summary(spark, sf_dir):
    r = Fixtures(spark, sf_dir).runs
    public = F.concat(F.lit(PUBLIC_BASE + "/llms-txt/llms_"), F.col("id").cast("string"), F.lit(".txt"))
    manual = F.concat(F.lit("https://site-"), F.col("project_id").cast("string"), F.lit(".example.com"))
    given = F.when(F.col("is_scheduled"), F.lit("scheduled run"))
    return r.select("id", "status", labels.run_summary("status", given, public, manual).alias("summary"))


@register("next_run_daily", f"SELECT event_id, ts AS now_ts, {duck_next_daily('ts')} AS next_run_at FROM events")
def q_next_run_daily(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).table("events").select("event_id", F.col("ts").cast("timestamp").alias("now_ts"))
    return ev.select("event_id", "now_ts", schedule.next_run_daily("now_ts").alias("next_run_at"))


@register("next_run_weekly", f"SELECT event_id, ts AS now_ts, {duck_next_weekly('ts')} AS next_run_at FROM events")
def q_next_run_weekly(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).table("events").select("event_id", F.col("ts").cast("timestamp").alias("now_ts"))
    return ev.select("event_id", "now_ts", schedule.next_run_weekly("now_ts").alias("next_run_at"))


@register("scheduled_job_payload", """SELECT event_id, 'scheduled_' || CAST(user_id AS VARCHAR) || '_' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS job_id,
   json_object('id', 'scheduled_' || CAST(user_id AS VARCHAR) || '_' || CAST(epoch_us(ts) // 1000000 AS VARCHAR), 'projectId', user_id,
     'url', 'https://site-' || CAST(user_id AS VARCHAR) || '.example.com', 'priority', 'scheduled', 'render_mode', 'scheduled', 'isScheduled', true,
     'scheduledAt', epoch_us(ts) // 1000, 'runId', 'run_' || CAST(event_id AS VARCHAR),
     'metadata', json_object('cron_expression', '0 2 * * *', 'scheduled_by', 'worker'))::VARCHAR AS payload FROM events""")
def q_scheduled_job_payload(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).table("events")
    t = F.col("ts").cast("timestamp")
    dom = F.concat(F.lit("https://site-"), F.col("user_id").cast("string"), F.lit(".example.com"))
    run = F.concat(F.lit("run_"), F.col("event_id").cast("string"))
    return ev.select("event_id", payloads.scheduled_job_id(F.col("user_id"), t).alias("job_id"),
                     payloads.scheduled_payload(F.col("user_id"), dom, run, F.lit("0 2 * * *"), t).alias("payload"))


@register("webhook_payload", O.with_fx(f"""SELECT id, json_object('created_at', strftime(attempted_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(attempted_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(attempted_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00',
   'llms_txt_url', 'https://store.example/public/llms-txt/llms_' || CAST(webhook_id AS VARCHAR) || '.txt')::VARCHAR AS payload,
   CASE WHEN webhook_id % 2 = 0 THEN '{{"Content-Type":"application/json","User-Agent":"llmstxt-crawler/1.0","X-Webhook-Secret":"s' || CAST(webhook_id AS VARCHAR) || '"}}'
        ELSE '{{"Content-Type":"application/json","User-Agent":"llmstxt-crawler/1.0"}}' END AS headers_json FROM fx_webhook_events"""))
def q_webhook_payload(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).webhook_events
    url = F.concat(F.lit("https://store.example/public/llms-txt/llms_"), F.col("webhook_id").cast("string"), F.lit(".txt"))
    secret = F.when(F.col("webhook_id") % 2 == 0, F.concat(F.lit("s"), F.col("webhook_id").cast("string")))
    return ev.select("id", payloads.webhook_payload(F.col("attempted_at"), url).alias("payload"),
                     F.to_json(payloads.webhook_headers(secret)).alias("headers_json"))


@register("delivery_result", """SELECT event_id AS id, CASE WHEN event_type='error' THEN NULL ELSE 200 END AS status_code,
   CASE WHEN event_type='error' THEN 'Request timeout' WHEN event_type='view' THEN NULL ELSE substring(repeat(props, 150), 1, 1000) END AS response_body
   FROM events""")
def q_delivery_result(spark, sf_dir):
    ev = Fixtures(spark, sf_dir).table("events")
    et = F.col("event_type")
    body = F.when(et == "view", F.lit("")).otherwise(F.repeat("props", 150))
    kind = F.when(et == "error", F.lit("timeout"))
    return ev.select(F.col("event_id").alias("id"), payloads.delivery_status_code(F.lit(200), kind).alias("status_code"),
                     payloads.delivery_response_body(body, kind, F.lit(None).cast("string")).alias("response_body"))


@register("artifact_delivery_kind", O.with_fx("""SELECT id, CASE WHEN coalesce(public_url,'')<>'' THEN 'redirect' WHEN coalesce(storage_path,'')<>'' THEN 'pointer'
   ELSE 'placeholder' END AS delivery_kind FROM fx_artifacts"""))
def q_artifact_delivery_kind(spark, sf_dir):
    a = Fixtures(spark, sf_dir).artifacts
    return a.select("id", labels.artifact_delivery_kind(F.col("public_url"), F.col("storage_path"), F.lit(None).cast("string"))
                    .alias("delivery_kind"))


@register("nonempty_url", O.with_fx("""SELECT project_id, count(*) AS n_pages, count(*) FILTER (WHERE coalesce(url,'')<>'') AS n_lines
   FROM fx_crawled GROUP BY project_id""", O.budget_cte(SITE_INDEX_MAX_PAGES), ("fx_crawled", "SELECT * FROM fx_budget WHERE fetched AND status_code=200")))
def q_nonempty_url(spark, sf_dir):
    """F8: pages without URL are left out of the document's list."""
    c = crawl_job(spark, sf_dir).crawled
    return c.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_pages"),
                                       F.count_if(F.coalesce(F.col("url"), F.lit("")) != "").alias("n_lines"))
