"""Notifications as tables: active webhooks (F4), ownership (J6), project
events (J8), newest delivery (W4) with outcome (P21), fan-out to an outbox
(J11) and the delivery log rows (S11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import labels, payloads
from .ranking import latest_per_key


def active_webhooks(webhooks: DataFrame) -> DataFrame:
    """webhooks with ``is_active`` (event types are not consulted)."""
    return webhooks.filter(F.coalesce(F.col("is_active"), F.lit(False)))


def owned_webhooks(webhooks: DataFrame, projects: DataFrame, user=None) -> DataFrame:
    """Webhooks joined to their project, with the project's owner; only the
    given user's when ``user`` is set."""
    p = projects.select(F.col("id").alias("_pid"), F.col("created_by").alias("owner"))
    j = webhooks.join(p, webhooks["project_id"] == p["_pid"]).drop("_pid")
    return j if user is None else j.filter(F.col("owner") == F.lit(user))


def project_events(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Delivery events of webhooks, keyed by the webhook's project."""
    w = webhooks.select(F.col("id").alias("_wid"), "project_id")
    return events.join(w, events["webhook_id"] == w["_wid"]).drop("_wid")


def latest_event(events: DataFrame) -> DataFrame:
    """Newest attempt per webhook (attempted_at, then id)."""
    return latest_per_key(events, ["webhook_id"], ["attempted_at", "id"],
                          ["id", "attempted_at", "status_code"])


def webhook_status(webhooks: DataFrame, events: DataFrame) -> DataFrame:
    """W4 + P21 per webhook: last attempt (or 'Not run yet') and its outcome."""
    last = latest_event(events).select(F.col("webhook_id").alias("_wid"), F.col("attempted_at").alias("last_attempted_at"),
                                       F.col("status_code").alias("last_status_code"))
    j = webhooks.join(last, webhooks["id"] == last["_wid"], "left").drop("_wid")
    return j.select(
        F.col("id").alias("webhook_id"), "project_id", "last_attempted_at", "last_status_code",
        F.when(F.col("last_attempted_at").isNull(), F.lit(labels.NOT_RUN_YET))
         .otherwise(F.date_format("last_attempted_at", "yyyy-MM-dd HH:mm:ss")).alias("last_attempted"),
        F.when(F.col("last_attempted_at").isNotNull(), labels.delivery_outcome("last_status_code")).alias("outcome"))


def fanout(actions: DataFrame, webhooks: DataFrame, now) -> DataFrame:
    """One outbox row per (run that must notify) x (active webhook of its
    project), with the JSON body and headers to send.

    1:N join on project_id; AQE splits a skewed project's partition and
    replicates the (small) webhook side for it.
    """
    ts = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    notify = actions.filter(F.col("notify")).select("run_id", "project_id", "notify_url")
    wh = active_webhooks(webhooks).select(F.col("id").alias("webhook_id"), F.col("project_id").alias("_pid"),
                                          F.col("url").alias("webhook_url"),
                                          (F.col("secret") if "secret" in webhooks.columns
                                           else F.lit(None).cast("string")).alias("secret"))
    j = notify.join(wh, notify["project_id"] == wh["_pid"]).drop("_pid")
    return j.select("run_id", "project_id", "webhook_id", "webhook_url",
                    F.lit(S.EVENT_RUN_COMPLETE).alias("event_type"),
                    payloads.webhook_payload(ts, F.col("notify_url")).alias("payload"),
                    payloads.webhook_headers(F.col("secret")).alias("headers"))


def subscriptions(webhooks: DataFrame) -> DataFrame:
    """An index from event type to webhooks: (project_id, event_type, id, url, secret), a row for each
    type that an active webhook asks for; without ``event_types`` it asks for finished runs."""
    asked = F.col("event_types") if "event_types" in webhooks.columns else F.lit(None).cast("array<string>")
    types = F.array_distinct(F.coalesce(asked, F.array(F.lit(S.EVENT_RUN_COMPLETE))))
    secret = F.col("secret") if "secret" in webhooks.columns else F.lit(None).cast("string")
    return active_webhooks(webhooks).select("project_id", F.explode(types).alias("event_type"), "id", "url", secret.alias("secret"))


def notify(events: DataFrame, index: DataFrame) -> DataFrame:
    """What happened (project_id, event_type, ...) met with the webhooks that ask for it, by the index's key."""
    asked = index.select("project_id", "event_type", F.col("id").alias("webhook_id"), F.col("url").alias("webhook_url"))
    return events.join(asked, ["project_id", "event_type"])


def event_rows(deliveries: DataFrame, now=None) -> DataFrame:
    """Delivery log rows from delivery results (P25).

    ``deliveries``: id, webhook_id, payload, status_code, body, error_kind
    (null / 'timeout' / 'error'), error_message, attempted_at (or ``now``).
    """
    at = F.col("attempted_at") if now is None else (now if isinstance(now, Column) else F.lit(now).cast("timestamp"))
    return deliveries.select(
        "id", "webhook_id", F.lit(S.EVENT_RUN_COMPLETE).alias("event_type"), "payload",
        payloads.delivery_status_code("status_code", "error_kind").alias("status_code"),
        payloads.delivery_response_body("body", "error_kind", "error_message").alias("response_body"),
        at.alias("attempted_at"))
