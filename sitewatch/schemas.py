"""Every table schema of the data model, declared once (no inference)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

S, I, L, B, T = StringType(), IntegerType(), LongType(), BooleanType(), TimestampType()


def _st(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# --- fixed values: status and type vocabularies used by the code -----------
RUN_QUEUED = "QUEUED"
RUN_IN_PROGRESS = "IN_PROGRESS"
RUN_COMPLETE_NO_DIFFS = "COMPLETE_NO_DIFFS"
RUN_COMPLETE_WITH_DIFFS = "COMPLETE_WITH_DIFFS"
RUN_FAILED = "FAILED"
RUN_RETRYING = "RETRYING"
COMPLETE_STATUSES = (RUN_COMPLETE_NO_DIFFS, RUN_COMPLETE_WITH_DIFFS)
TERMINAL_STATUSES = (RUN_COMPLETE_NO_DIFFS, RUN_COMPLETE_WITH_DIFFS, RUN_FAILED)
ACTIVE_STATUSES = (RUN_QUEUED, RUN_IN_PROGRESS)
KNOWN_RUN_STATUSES = (RUN_QUEUED, RUN_IN_PROGRESS, RUN_COMPLETE_NO_DIFFS,
                      RUN_COMPLETE_WITH_DIFFS, RUN_FAILED, RUN_RETRYING)
RENDER_MODES = ("STATIC", "JS", "HYBRID")
ARTIFACT_TYPES = ("LLMS_TXT", "JSON", "OTHER")
ARTIFACT_LLMS_TXT = "LLMS_TXT"
EVENT_RUN_COMPLETE = "run.complete"
CRON_DAILY = "0 2 * * *"
CRON_WEEKLY = "0 2 * * 0"
DEFAULT_MAX_PAGES_JOB = 100
DEFAULT_MAX_PAGES_LIBRARY = 200
DEFAULT_MAX_DEPTH = 2
RESPONSE_BODY_LIMIT = 1000
ARTIFACT_BUCKET = "llms-txt"
ARTIFACT_PREFIX = "llms_"
ARTIFACT_SUFFIX = ".txt"
# ---------------------------------------------------------------------------

SNAPSHOT = _st(("project_id", S), ("url", S), ("status_code", I), ("body", S))

PAGE_CATALOGUE_COLUMNS = ("id", "project_id", "url", "path", "canonical_url", "current_revision_id",
                          "last_seen_at", "render_mode", "is_indexable", "metadata")

PROJECTS = _st(("id", S), ("created_by", S), ("name", S), ("domain", S), ("description", S),
               ("created_at", T), ("updated_at", T), ("metadata", S))
PROJECT_CONFIGS = _st(("project_id", S), ("crawl_depth", I), ("cron_expression", S), ("last_run_at", T),
                      ("next_run_at", T), ("is_enabled", B), ("config", S))
WEBHOOKS = StructType([StructField("id", S), StructField("project_id", S), StructField("url", S),
                       StructField("event_types", ArrayType(S)), StructField("secret", S),
                       StructField("is_active", B), StructField("created_at", T), StructField("updated_at", T)])
RUNS = _st(("id", S), ("project_id", S), ("initiated_by", S), ("started_at", T), ("finished_at", T),
           ("summary", S), ("status", S), ("created_at", T), ("updated_at", T), ("metrics", S))
PAGES = _st(("id", S), ("project_id", S), ("url", S), ("path", S), ("canonical_url", S), ("last_seen_at", T),
            ("render_mode", S), ("discovered_at", T), ("is_indexable", B), ("metadata", S),
            ("current_revision_id", S))
PAGE_REVISIONS = _st(("id", S), ("page_id", S), ("run_id", S), ("content", S), ("content_sha256", S),
                     ("title", S), ("meta_description", S), ("created_at", T), ("metadata", S))
ARTIFACTS = _st(("id", S), ("project_id", S), ("run_id", S), ("type", S), ("storage_path", S),
                ("file_name", S), ("size_bytes", L), ("downloaded_count", I), ("created_at", T), ("metadata", S))
WEBHOOK_EVENTS = _st(("id", S), ("webhook_id", S), ("event_type", S), ("payload", S), ("status_code", I),
                     ("response_body", S), ("attempted_at", T))

# Job payload as sent to the worker (JSON).
JOB_PAYLOAD = StructType([
    StructField("id", S), StructField("url", S), StructField("projectId", S), StructField("runId", S),
    StructField("priority", S), StructField("render_mode", S), StructField("isScheduled", B),
    StructField("isInitialRun", B), StructField("scheduledAt", L), StructField("metadata", S)])
