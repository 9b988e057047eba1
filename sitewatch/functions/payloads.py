"""JSON payloads and delivery rows: scheduled job (P23), webhook call (P24),
delivery result (P25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .labels import iso_utc

# --- fixed values ----------------------------------------------------------
SCHEDULED_PRIORITY = "scheduled"
SCHEDULED_BY = "worker"
WEBHOOK_CONTENT_TYPE = "application/json"
WEBHOOK_USER_AGENT = "llmstxt-crawler/1.0"
WEBHOOK_SECRET_HEADER = "X-Webhook-Secret"
TIMEOUT_TEXT = "Request timeout"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheduled_job_id(project_id, next_run) -> Column:
    """``scheduled_{project}_{epoch seconds}``."""
    return F.concat(F.lit("scheduled_"), _c(project_id).cast("string"), F.lit("_"),
                    F.unix_seconds(_c(next_run)).cast("string"))


def scheduled_payload(project_id, domain, run_id, cron, next_run) -> Column:
    """The queued job's JSON (``scheduledAt`` in milliseconds)."""
    return F.to_json(F.struct(
        scheduled_job_id(project_id, next_run).alias("id"),
        _c(project_id).alias("projectId"),
        _c(domain).alias("url"),
        F.lit(SCHEDULED_PRIORITY).alias("priority"),
        F.lit(SCHEDULED_PRIORITY).alias("render_mode"),
        F.lit(True).alias("isScheduled"),
        F.unix_millis(_c(next_run)).alias("scheduledAt"),
        _c(run_id).alias("runId"),
        F.struct(_c(cron).alias("cron_expression"), F.lit(SCHEDULED_BY).alias("scheduled_by")).alias("metadata")))


def webhook_payload(now, llms_txt_url) -> Column:
    """``{created_at, llms_txt_url}`` as JSON."""
    return F.to_json(F.struct(iso_utc(now).alias("created_at"), _c(llms_txt_url).alias("llms_txt_url")))


def webhook_headers(secret) -> Column:
    """Request headers; the secret header only when a secret is set."""
    s = _c(secret)
    base = F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("User-Agent")),
                             F.array(F.lit(WEBHOOK_CONTENT_TYPE), F.lit(WEBHOOK_USER_AGENT)))
    return F.when(F.coalesce(s, F.lit("")) != "",
                  F.map_concat(base, F.create_map(F.lit(WEBHOOK_SECRET_HEADER), s))).otherwise(base)


def delivery_status_code(status_code, error_kind) -> Column:
    """P25: the HTTP code, null when the call timed out or failed."""
    return F.when(_c(error_kind).isNull(), _c(status_code).cast("int"))


def delivery_response_body(body, error_kind, error_message) -> Column:
    """P25: body cut at 1000 characters (empty -> null); 'Request timeout';
    the error message for any other failure."""
    b = _c(body)
    kind = _c(error_kind)
    return (F.when(kind == "timeout", F.lit(TIMEOUT_TEXT))
            .when(kind.isNotNull(), _c(error_message))
            .when(F.coalesce(b, F.lit("")) != "", F.substring(b, 1, S.RESPONSE_BODY_LIMIT)))
