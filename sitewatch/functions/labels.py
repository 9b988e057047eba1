"""Display and decision expressions: run summary (P15), schedule label (P19),
status label (P20), delivery outcome (P21), effective time (P26), artifact
delivery kind (P27), defaults (P28)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# --- fixed values: texts shown or stored -----------------------------------
STATUS_LABELS = {
    "COMPLETE_WITH_DIFFS": "Changes Detected",
    "COMPLETE_NO_DIFFS": "No Changes",
    "IN_PROGRESS": "In Progress",
    "FAILED": "Failed",
    "RETRYING": "Retrying",
    "QUEUED": "Queued",
}
SCHEDULE_NONE, SCHEDULE_DAILY, SCHEDULE_WEEKLY, SCHEDULE_CUSTOM = "None", "Daily", "Weekly", "Custom"
FAILED_PREFIX = "Generation failed"
SUMMARY_NO_CHANGES = "No changes detected, skipping generation"
SUMMARY_SUCCESS_PREFIX = "Successfully generated llms.txt file. Artifact: "
SUMMARY_MANUAL_PREFIX = "Generation run for "
NOT_RUN_YET = "Not run yet"
OUTCOME_SUCCESS, OUTCOME_FAILURE = "Success", "Failure"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def failed_summary(summary) -> Column:
    """P15 for FAILED: ``Generation failed: {summary}`` or plain ``Generation failed``
    (prefix applied once)."""
    s = _c(summary)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(FAILED_PREFIX + ": "), s)).otherwise(F.lit(FAILED_PREFIX))


def run_summary(status, summary=None, public_url=None, manual_url=None) -> Column:
    """Summary text stored with a status change."""
    st = _c(status)
    given = _c(summary) if summary is not None else F.lit(None).cast("string")
    out = F.when(st == S.RUN_FAILED, failed_summary(given))
    if public_url is not None:
        out = out.when(st.isin(*S.COMPLETE_STATUSES) & _c(public_url).isNotNull(),
                       F.concat(F.lit(SUMMARY_SUCCESS_PREFIX), _c(public_url)))
    if manual_url is not None:
        out = out.when(st == S.RUN_QUEUED, F.concat(F.lit(SUMMARY_MANUAL_PREFIX), _c(manual_url)))
    return out.otherwise(given)


def schedule_label(cron) -> Column:
    """None / Daily / Weekly / Custom."""
    c = _c(cron)
    return (F.when(c.isNull() | (c == ""), F.lit(SCHEDULE_NONE))
            .when(c == S.CRON_DAILY, F.lit(SCHEDULE_DAILY))
            .when(c == S.CRON_WEEKLY, F.lit(SCHEDULE_WEEKLY))
            .otherwise(F.lit(SCHEDULE_CUSTOM)))


def status_label(status) -> Column:
    """P20: display text of a run status, the raw value when unknown."""
    st = _c(status)
    out = None
    for k, v in STATUS_LABELS.items():
        out = (F.when(st == k, F.lit(v)) if out is None else out.when(st == k, F.lit(v)))
    return out.otherwise(st)


def delivery_outcome(status_code) -> Column:
    """Success for 2xx, Failure for >= 400, null for 1xx/3xx/null."""
    c = _c(status_code)
    return (F.when((c >= 200) & (c < 300), F.lit(OUTCOME_SUCCESS))
            .when(c >= 400, F.lit(OUTCOME_FAILURE)))


def effective_time(finished_at="finished_at", created_at="created_at") -> Column:
    """``finished_at``, else ``created_at`` (the run card uses started_at)."""
    return F.coalesce(_c(finished_at), _c(created_at))


def artifact_delivery_kind(public_url, storage_path, inline_content) -> Column:
    """Redirect / pointer / body / placeholder, first hit wins."""
    return (F.when(F.coalesce(_c(public_url), F.lit("")) != "", F.lit("redirect"))
            .when(F.coalesce(_c(storage_path), F.lit("")) != "", F.lit("pointer"))
            .when(F.coalesce(_c(inline_content), F.lit("")) != "", F.lit("body"))
            .otherwise(F.lit("placeholder")))


def placeholder_document(project_id, run_id, status, now) -> Column:
    """P27 fallback text (``now`` is passed in, never read from the clock)."""
    return F.concat(
        F.lit("Site: "), _c(project_id).cast("string"),
        F.lit("\nGenerated-At: "), F.date_format(_c(now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit("\nStatus: "), _c(status),
        F.lit("\n\n[Note]\nThis is a placeholder llms.txt file. The actual generated content will be "
              "available once the worker processes this run.\n\nRun ID: "), _c(run_id).cast("string"),
        F.lit("\nProject ID: "), _c(project_id).cast("string"), F.lit("\n"))


def iso_utc(ts) -> Column:
    """Python ``datetime.isoformat()`` of a UTC instant (microseconds only when
    not zero, ``+00:00`` suffix)."""
    t = _c(ts)
    micros = F.unix_micros(t) % 1000000
    return F.when(micros == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
