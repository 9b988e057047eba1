"""Run lifecycle and run read model: transitions (R1), completion actions (R2),
job outcome (R3), next schedule (R4), initial runs (R5), run inserts (S12),
filters (F5-F7), per-project facts (A5, A6, W5, W6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import labels, payloads, schedule, urls
from .ranking import latest_per_key, rank_within


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


# --- filters ----------------------------------------------------------------
def active_runs(runs: DataFrame) -> DataFrame:
    """QUEUED or IN_PROGRESS (the tasks to cancel when a project goes)."""
    return runs.filter(F.col("status").isin(*S.ACTIVE_STATUSES))


def completed_runs(runs: DataFrame) -> DataFrame:
    """COMPLETE_NO_DIFFS or COMPLETE_WITH_DIFFS."""
    return runs.filter(F.col("status").isin(*S.COMPLETE_STATUSES))


# --- per-project facts --------------------------------------------------------
def has_active_run(runs: DataFrame) -> DataFrame:
    """A5: any IN_PROGRESS run per project (partial aggregate)."""
    return runs.groupBy("project_id").agg(F.bool_or(F.col("status") == S.RUN_IN_PROGRESS).alias("has_active_run"))


def last_run_at(runs: DataFrame) -> DataFrame:
    """Time of the latest terminal run (COMPLETE_* or FAILED) per project."""
    return (runs.filter(F.col("status").isin(*S.TERMINAL_STATUSES))
            .groupBy("project_id").agg(F.max("finished_at").alias("last_run_at")))


def last_complete_run(runs: DataFrame) -> DataFrame:
    """Newest COMPLETE_* run per project by effective time (P26), id breaks ties."""
    done = completed_runs(runs).withColumn("effective_at", labels.effective_time())
    return latest_per_key(done, ["project_id"], ["effective_at", "id"])


def index_history(runs: DataFrame) -> DataFrame:
    """COMPLETE_WITH_DIFFS runs newest first per project, with position and
    ``is_latest``.  Skew-safe ranking (a single site may own most runs)."""
    hist = (runs.filter(F.col("status") == S.RUN_COMPLETE_WITH_DIFFS)
            .withColumn("effective_at", labels.effective_time()))
    ranked = rank_within(hist, ["project_id"], [F.col("effective_at").desc(), F.col("id").desc()], "position")
    return ranked.withColumn("is_latest", F.col("position") == 1)


# --- transitions ----------------------------------------------------------------
def apply_transitions(runs: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Apply status changes to runs.

    ``changes``: run_id, status, summary, finished_at (optional), seq (order of
    changes of one run).  The outcome is that of applying them one by one: the
    last one gives the status and always ``updated_at``; the last one to
    COMPLETE_* / FAILED gives ``finished_at`` (its own, else ``now``), and the
    last of those that says something gives the summary, FAILED with its prefix.
    A partial aggregate per run, whatever the number of its changes.
    """
    ts = _ts(now)
    given = F.col("finished_at") if "finished_at" in changes.columns else F.lit(None).cast("timestamp")
    terminal = F.col("status").isin(*S.TERMINAL_STATUSES)
    said = (F.when(F.col("status") == S.RUN_FAILED, labels.failed_summary(F.col("summary")))
            .when(terminal & (F.col("summary") != ""), F.col("summary")))
    last = changes.groupBy(F.col("run_id").alias("_rid")).agg(
        F.max_by("status", "seq").alias("_st"),
        F.max_by(F.struct(given.alias("at")), F.when(terminal, F.col("seq"))).alias("_fin"),
        F.max_by(said, F.when(said.isNotNull(), F.col("seq"))).alias("_sum"))
    j = runs.join(last, runs["id"] == last["_rid"], "left")
    hit = F.col("_rid").isNotNull()
    terminal = F.col("_fin").isNotNull()
    new_summary = F.coalesce(F.col("_sum"), F.col("summary")) if "summary" in runs.columns else F.col("_sum")
    out = []
    for c in runs.columns:
        if c == "status":
            out.append(F.when(hit, F.col("_st")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, ts).otherwise(F.col(c)).alias(c))
        elif c == "finished_at":
            out.append(F.when(hit & terminal, F.coalesce(F.col("_fin.at"), ts)).otherwise(F.col(c)).alias(c))
        elif c == "summary":
            out.append(F.when(hit & terminal, new_summary).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    if "updated_at" not in runs.columns:
        out.append(F.when(hit, ts).alias("updated_at"))
    if "summary" not in runs.columns:
        out.append(F.when(hit & terminal, new_summary).alias("summary"))
    return j.select(*out)


def completion_actions(runs: DataFrame, latest_urls: DataFrame) -> DataFrame:
    """R2: per finished run, what happens next.

    ``runs``: id, project_id, status, is_scheduled, is_initial, llms_txt_url
    (optional, the URL of the document this run wrote).  ``latest_urls``:
    project_id, latest_url (W3a).  Decision table: touch last_run_at when
    COMPLETE_*/FAILED with a project; schedule next when COMPLETE_* and
    (scheduled or initial); notify when COMPLETE_* with a non-empty URL and
    (manual run or WITH_DIFFS).  URL = the run's own, else the project's latest.
    """
    st = F.col("status")
    has_project = F.col("project_id").isNotNull()
    complete = st.isin(*S.COMPLETE_STATUSES)
    own = F.col("llms_txt_url") if "llms_txt_url" in runs.columns else F.lit(None).cast("string")
    j = runs.join(latest_urls.select("project_id", "latest_url"), "project_id", "left")
    url = F.coalesce(F.when(F.coalesce(own, F.lit("")) != "", own), F.col("latest_url"))
    sched = F.coalesce(F.col("is_scheduled"), F.lit(False))
    init = F.coalesce(F.col("is_initial"), F.lit(False))
    return j.select(
        F.col("id").alias("run_id"), "project_id", "status",
        ((complete | (st == S.RUN_FAILED)) & has_project).alias("touch_last_run"),
        (complete & has_project & (sched | init)).alias("schedule_next"),
        (complete & has_project & (F.coalesce(url, F.lit("")) != "")
         & (~sched | (st == S.RUN_COMPLETE_WITH_DIFFS))).alias("notify"),
        F.when(complete & has_project, url).alias("notify_url"))


def job_outcome(jobs: DataFrame, summary: DataFrame | None, documents: DataFrame, public_base: str) -> DataFrame:
    """Per job, COMPLETE_NO_DIFFS without a document when nothing changed,
    else COMPLETE_WITH_DIFFS with its document and artifact URL."""
    from .index import artifact_location
    name, path, public = artifact_location(F.col("job_id"), public_base)
    if summary is None:
        # documents exist exactly for the projects with changes
        j = jobs.join(documents.withColumn("has_changes", F.lit(True)), "project_id", "left")
    else:
        j = (jobs.join(summary.select("project_id", "has_changes"), "project_id", "left")
             .join(documents, "project_id", "left"))
    changed = F.coalesce(F.col("has_changes"), F.lit(False))
    status = F.when(changed, F.lit(S.RUN_COMPLETE_WITH_DIFFS)).otherwise(F.lit(S.RUN_COMPLETE_NO_DIFFS))
    return j.select(
        "job_id", "run_id", "project_id", status.alias("status"),
        F.when(changed, F.col("document")).alias("document"),
        F.when(changed, public).alias("llms_txt_url"),
        F.when(changed, F.concat(F.lit(labels.SUMMARY_SUCCESS_PREFIX), public))
         .otherwise(F.lit(labels.SUMMARY_NO_CHANGES)).alias("summary"))


# --- scheduling -----------------------------------------------------------------
def schedulable(configs: DataFrame, projects: DataFrame, now) -> DataFrame:
    """F5 over J4: enabled, cron set, next run computable, domain not empty."""
    from .catalog import config_with_domain
    j = config_with_domain(configs, projects)
    nxt = schedule.next_run(F.col("cron_expression"), _ts(now))
    return (j.withColumn("next_run_at", nxt)
            .filter(F.coalesce(F.col("is_enabled"), F.lit(False))
                    & (F.coalesce(F.col("cron_expression"), F.lit("")) != "")
                    & F.col("next_run_at").isNotNull()
                    & (F.coalesce(F.col("domain"), F.lit("")) != "")))


def repeatable_run_id(project_id: Column, at: Column, kind: str) -> Column:
    """Run id from (project, time, kind) -- retried jobs produce the same id."""
    return F.concat(F.lit("run_"), F.sha2(
        F.concat_ws("|", F.lit(kind), project_id.cast("string"), F.unix_micros(at).cast("string")), 256))


def schedule_next(configs: DataFrame, projects: DataFrame, now) -> DataFrame:
    """For every schedulable project a new QUEUED run, its job payload and
    the config's new last/next run times."""
    ts = _ts(now)
    s = schedulable(configs, projects, now)
    run_id = repeatable_run_id(F.col("project_id"), F.col("next_run_at"), "scheduled")
    return s.select(
        "project_id", run_id.alias("run_id"), F.lit(S.RUN_QUEUED).alias("status"), ts.alias("created_at"),
        payloads.scheduled_job_id(F.col("project_id"), F.col("next_run_at")).alias("job_id"),
        payloads.scheduled_payload(F.col("project_id"), F.col("domain"), run_id, F.col("cron_expression"),
                                   F.col("next_run_at")).alias("payload"),
        ts.alias("last_run_at"), F.col("next_run_at"))


def create_runs(requests: DataFrame, now, kind: str = "manual") -> DataFrame:
    """QUEUED run rows for requests (project_id, initiated_by, url?)."""
    ts = _ts(now)
    url = F.col("url") if "url" in requests.columns else F.lit(None).cast("string")
    return requests.select(
        repeatable_run_id(F.col("project_id"), ts, kind).alias("id"), "project_id",
        F.col("initiated_by") if "initiated_by" in requests.columns else F.lit(None).cast("string").alias("initiated_by"),
        F.lit(S.RUN_QUEUED).alias("status"),
        F.when(url.isNotNull(), F.concat(F.lit(labels.SUMMARY_MANUAL_PREFIX), url)).alias("summary"),
        ts.alias("created_at"), F.lit("{}").alias("metrics"))


def initial_runs(projects: DataFrame, configs: DataFrame, now) -> DataFrame:
    """Each enabled new project gets a run and an immediate job flagged
    ``isInitialRun``."""
    ts = _ts(now)
    j = projects.join(configs.select("project_id", "is_enabled"), projects["id"] == configs["project_id"])
    run_id = repeatable_run_id(F.col("id"), ts, "initial")
    job_id = F.concat(F.lit("job_"), F.sha2(run_id, 256))
    payload = F.to_json(F.struct(
        job_id.alias("id"), F.col("domain").alias("url"), F.col("id").alias("projectId"), run_id.alias("runId"),
        F.lit("NORMAL").alias("priority"), F.lit("STATIC").alias("render_mode"),
        F.lit(False).alias("isScheduled"), F.lit(True).alias("isInitialRun")))
    return (j.filter(F.coalesce(F.col("is_enabled"), F.lit(True)))
            .select(F.col("id").alias("project_id"), run_id.alias("run_id"),
                    F.col("created_by").alias("initiated_by"), F.lit(S.RUN_QUEUED).alias("status"),
                    ts.alias("created_at"), job_id.alias("job_id"), payload.alias("payload")))


def create_projects(requests: DataFrame, now) -> dict[str, DataFrame]:
    """A request becomes a project with its configuration and, if enabled, a first run.

    ``requests``: request_id, created_by, name, domain, description and, where given,
    crawl_depth, cron_expression (a schedule's name) and is_enabled.  P22 decides;
    what it refuses is ``rejected`` with the reason.  P28 fills in, P18 turns the
    schedule into a cron expression and the next time, R5 makes the first runs.
    The project's id is made from the request's, so a retried request makes the same rows.
    """
    from .catalog import fill_defaults, validate_projects
    ts = _ts(now)
    checked = fill_defaults(validate_projects(requests), "project")
    ok = checked.filter("is_valid").withColumn("id", F.concat(F.lit("prj_"), F.sha2(F.col("request_id").cast("string"), 256)))
    cron, next_run_at = schedule.schedule_to_cron("cron_expression", ts)
    projects = ok.select("id", "created_by", "name", "domain", "description", ts.alias("created_at"), ts.alias("updated_at"), "metadata")
    configs = ok.select(F.col("id").alias("project_id"), "crawl_depth", cron.alias("cron_expression"),
                        F.lit(None).cast("timestamp").alias("last_run_at"), next_run_at.alias("next_run_at"), "is_enabled",
                        F.lit("{}").alias("config"))
    return {"projects": projects, "configs": configs, "runs": initial_runs(projects, configs, now),
            "rejected": checked.filter(~F.col("is_valid")).select("request_id", "reject_reason")}
