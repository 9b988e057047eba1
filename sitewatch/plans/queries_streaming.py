"""Registered streaming queries (ST1-ST4).  Each writes its input stream from
the driver tables into the shared scratch folder, in several arrivals, runs the
stream with an available-now trigger and returns the sink's content as a batch
DataFrame, so it can be compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..session import materialize
from ..streaming import changes as st_changes
from ..streaming import deliveries as st_deliveries
from ..streaming import jobs as st_jobs
from ..streaming import runs as st_runs
from ..streaming.common import run_available_now, state_partitions, stream_dirs
from . import oracle as O
from .fixtures import Fixtures
from .queries import FIXED_NOW, PUBLIC_BASE, SITE_INDEX_MAX_PAGES, register
from .queries_crawl import site_index_ctes
from .queries_lifecycle import pipeline_tables, second_turn

JOB_COLS = ["id", "url", "projectId", "runId", "isScheduled", "isInitialRun"]


def _write_parts(parts, path):
    for df in parts:
        df.write.mode("append").parquet(path)


def _raw_job_parts(spark, sf_dir):
    """Job payloads of every run, in two arrivals plus a re-delivery of the
    scheduled runs (a queue retry)."""
    r = Fixtures(spark, sf_dir).runs
    i = F.col("id")
    value = F.to_json(F.struct(
        F.when(i % 7 != 0, F.concat(F.lit("job_"), i.cast("string"))).alias("id"),
        F.when(i % 11 != 0, F.concat(F.lit("https://site-"), F.col("project_id").cast("string"), F.lit(".example.com"))).alias("url"),
        F.when(i % 13 != 0, F.col("project_id")).alias("projectId"),
        F.when(i % 17 != 0, i.cast("string")).alias("runId"),
        F.when(i % 2 == 0, F.col("is_scheduled")).alias("isScheduled")))
    first = F.col("created_at") < F.lit("1995-01-01").cast("timestamp")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    p0 = r.filter(first).select(value.alias("value"), base.alias("received_at"))
    p1 = r.filter(~first).select(value.alias("value"), (base + F.expr("INTERVAL 1 MINUTE")).alias("received_at"))
    p2 = r.filter(F.col("is_scheduled")).select(value.alias("value"), (base + F.expr("INTERVAL 2 MINUTES")).alias("received_at"))
    return [p0, p1, p2]


@register("job_stream", """SELECT 'job_' || CAST(id AS VARCHAR) AS id, 'https://site-' || CAST(project_id AS VARCHAR) || '.example.com' AS url,
   CAST(project_id AS VARCHAR) AS projectId, CAST(id AS VARCHAR) AS runId, CASE WHEN id%2=0 THEN is_scheduled ELSE false END AS isScheduled,
   false AS isInitialRun FROM (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderkey%3=0 AS is_scheduled FROM orders)
   WHERE id%7<>0 AND id%11<>0 AND id%13<>0 AND id%17<>0""")
def q_job_stream(spark, sf_dir):
    d = stream_dirs(spark, "jobs")
    _write_parts(_raw_job_parts(spark, sf_dir), d["input"])
    raw = (spark.readStream.schema("value string, received_at timestamp").option("maxFilesPerTrigger", 1)
           .parquet(d["input"]))
    intake = st_jobs.JobIntake(spark, d["output"])
    with state_partitions(spark):
        run_available_now(st_jobs.job_stream(raw).writeStream.option("checkpointLocation", d["checkpoint"]).foreachBatch(intake.writer()))
    return intake.jobs(st_jobs.ACCEPTED).select(*JOB_COLS)


# the state before the first fetch, and what each fetch brings
CHANGE_STREAM_BASE = """SELECT *, 'rev_' || sha256(pid || '|fetch_1') AS rev1, 'rev_' || sha256(pid || '|fetch_2') AS rev2 FROM (
   SELECT x.project_id, x.url, x.status_code AS s1, x.h AS h1, coalesce(x.h, sha256(x.url)) AS h2,
     CASE WHEN length(x.url)%4=0 THEN sha256(x.url || 'v3') ELSE coalesce(x.h, sha256(x.url)) END AS h3,
     p.id IS NOT NULL AS known0, coalesce(p.id, 'pg_' || sha256(x.project_id || '|' || x.url)) AS pid, r.id AS rev0, r.content_sha256 AS stored0
   FROM fx_digest x LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, url ORDER BY id DESC) AS dup_rn FROM fx_pages) WHERE dup_rn=1) p
     ON p.project_id=x.project_id AND p.url=x.url LEFT JOIN fx_revisions r ON r.id=p.current_revision_id)"""


def _turn_sql(seq, known, ok, rev, stored, h, status="200"):
    """A turn's row out of the state before it, as SQL."""
    cls = (f"CASE WHEN NOT ({known}) THEN 'new' WHEN NOT ({ok}) OR {rev} IS NULL OR coalesce({stored},'')='' OR {stored}<>{h} "
           "THEN 'changed' ELSE 'unchanged' END")
    reason = (f"CASE WHEN NOT ({known}) THEN NULL WHEN NOT ({ok}) THEN concat('HTTP ',CAST({status} AS STRING),' on full fetch') "
              f"WHEN {rev} IS NULL THEN 'No previous revision found' WHEN coalesce({stored},'')='' THEN 'No stored content hash' "
              f"WHEN {stored}<>{h} THEN concat('Content hash changed: ',substring({stored},1,8),'... -> ',substring({h},1,8),'...') ELSE 'No changes detected' END")
    return f"SELECT project_id, url, CAST({seq} AS BIGINT) AS seq, {cls} AS change_class, {reason} AS change_reason, {rev} AS old_revision_id", cls


def _change_stream_sql() -> str:
    one, cls1 = _turn_sql(1, "known0", "s1=200", "rev0", "stored0", "h1", "s1")
    taken = f"(s1=200 AND {cls1}<>'unchanged')"
    two, cls2 = _turn_sql(2, "known1", "true", "old1", "stored1", "h2")
    three, _ = _turn_sql(3, "true", "true", "old2", "h2", "h3")
    return O.with_fx(f"""{one} FROM b UNION ALL {two} FROM b1 UNION ALL {three} FROM b2""", ("b", CHANGE_STREAM_BASE),
                     ("b1", f"SELECT *, known0 OR s1=200 AS known1, CASE WHEN {taken} THEN rev1 ELSE rev0 END AS old1, "
                            f"CASE WHEN {taken} THEN h1 ELSE stored0 END AS stored1 FROM b"),
                     ("b2", f"SELECT *, CASE WHEN {cls2}<>'unchanged' THEN rev2 ELSE old1 END AS old2 FROM b1"))


@register("change_stream", _change_stream_sql())
def q_change_stream(spark, sf_dir):
    """ST2: every page fetched three times, the last two in one micro-batch: as it is, found
    again (what failed answers now), and with new content for some."""
    fx = Fixtures(spark, sf_dir)
    d = stream_dirs(spark, "changes")
    one = materialize(ch.digest_snapshot(fx.fetch).select("project_id", "url", F.col("status_code").cast("int"), "content_sha256",
                                                          F.lit(1).cast("long").alias("seq")), "fetches")
    two = one.withColumns({"status_code": F.lit(200), "seq": F.lit(2).cast("long"),
                           "content_sha256": F.coalesce("content_sha256", F.sha2("url", 256))})
    three = two.withColumns({"seq": F.lit(3).cast("long"), "content_sha256": F.when(
        F.length("url") % 4 == 0, F.sha2(F.concat("url", F.lit("v3")), 256)).otherwise(F.col("content_sha256"))})
    run_id = F.concat(F.lit("fetch_"), F.col("seq").cast("string"))
    schema = "project_id string, url string, status_code int, content_sha256 string, seq long, run_id string"
    # an arrival is what its run of the stream finds new, all its files in one micro-batch
    for arrival in (one, two.unionByName(three)):
        _write_parts([arrival.withColumn("run_id", run_id)], d["input"])
        fetches = spark.readStream.schema(schema).parquet(d["input"])
        found = st_changes.change_stream(fetches, fx.pages, fx.revisions)
        with state_partitions(spark):
            run_available_now(found.writeStream.format("parquet").option("checkpointLocation", d["checkpoint"]).option("path", d["output"]))
    return spark.read.parquet(d["output"]).select("project_id", "url", "seq", "change_class", "change_reason", "old_revision_id")


@register("delivery_stream", O.with_fx("""SELECT webhook_id, id, attempted_at, status_code,
   CASE WHEN status_code>=200 AND status_code<300 THEN 'Success' WHEN status_code>=400 THEN 'Failure' END AS outcome
   FROM (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY attempted_at DESC, id DESC) AS rn FROM fx_webhook_events) WHERE rn=1"""))
def q_delivery_stream(spark, sf_dir):
    """ST3: delivery log arriving in two parts; the upsert sink holds the newest
    outcome per webhook."""
    ev = Fixtures(spark, sf_dir).webhook_events
    d = stream_dirs(spark, "deliveries")
    ok = F.coalesce(F.col("status_code") < 300, F.lit(True))
    _write_parts([ev.filter(ok), ev.filter(~ok)], d["input"])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(d["input"])
    agg = st_deliveries.delivery_stream(stream)
    with state_partitions(spark):
        run_available_now(agg.writeStream.outputMode("update").option("checkpointLocation", d["checkpoint"])
                          .foreachBatch(st_deliveries.batch_upsert_writer(d["output"])))
    return st_deliveries.read_upserts(spark, d["output"], "webhook_id")


@register("run_flow_stream", O.with_fx("""SELECT 'run_' || project_id AS run_id, document FROM fx_documents
   UNION ALL SELECT 'run_' || project_id || '_2', document FROM fx_documents_2 WHERE length(project_id)%2=0""",
   *site_index_ctes(SITE_INDEX_MAX_PAGES), *second_turn(site_index_ctes(SITE_INDEX_MAX_PAGES))))
def q_run_flow_stream(spark, sf_dir):
    """ST4: jobs of two runs of some sites in one micro-batch, of the others in the
    next, then all over again; documents by run id."""
    jobs, tables = pipeline_tables(Fixtures(spark, sf_dir))
    d = stream_dirs(spark, "runs")
    value = F.to_json(F.struct(F.col("job_id").alias("id"), F.col("start_url").alias("url"), F.col("project_id").alias("projectId"),
                               F.col("run_id").alias("runId"), F.col("is_scheduled").alias("isScheduled")))
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    even = F.length("project_id") % 2 == 0
    parts = [jobs.filter(even).select(value.alias("value"), base.alias("received_at")),
             jobs.filter(~even).select(value.alias("value"), (base + F.expr("INTERVAL 1 MINUTE")).alias("received_at")),
             jobs.filter(even).select(value.alias("value"), (base + F.expr("INTERVAL 2 MINUTES")).alias("received_at"))]
    flow = st_runs.RunFlow(spark, tables, d["output"], FIXED_NOW, PUBLIC_BASE, SITE_INDEX_MAX_PAGES)
    for arrival in parts:       # what a run of the stream finds new is one micro-batch
        _write_parts([arrival], d["input"])
        raw = spark.readStream.schema("value string, received_at timestamp").parquet(d["input"])
        with state_partitions(spark):
            run_available_now(st_jobs.job_stream(raw).writeStream.option("checkpointLocation", d["checkpoint"]).foreachBatch(flow.writer()))
    return spark.read.parquet(f"{d['output']}/documents").select("run_id", "document")
