"""Job intake (S5) and queue de-duplication.

A job is a JSON document ``{id, url, projectId, runId, isScheduled,
isInitialRun, ...}``.  It is accepted only when id, url, projectId and runId
are all present and not empty; the two flags default to false.  Rejected rows
are kept with a reason instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import variants
from ..operators.ranking import latest_per_key

# --- fixed values ----------------------------------------------------------
REJECT_REASON = "job must contain id+url+project id+run id"
# ---------------------------------------------------------------------------


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def parse_jobs(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse job JSON with a declared schema (no inference).

    Output: the payload fields, ``accepted`` and ``reject_reason``; other
    columns of ``raw`` are carried along.
    """
    parsed = F.from_json(F.col(value_col), schemas.JOB_PAYLOAD)
    carry = [c for c in raw.columns if c != value_col]
    # behind a generator a payload is parsed once, whatever filters on its fields
    out = raw.select(*carry, F.explode(F.array(parsed)).alias("_j"))
    ok = (_present(F.col("_j.id")) & _present(F.col("_j.url")) & _present(F.col("_j.projectId"))
          & _present(F.col("_j.runId")))
    ok = F.coalesce(ok, F.lit(False))
    return out.select(
        *carry,
        F.col("_j.id").alias("id"), F.col("_j.url").alias("url"), F.col("_j.projectId").alias("projectId"),
        F.col("_j.runId").alias("runId"),
        F.coalesce(F.col("_j.isScheduled"), F.lit(False)).alias("isScheduled"),
        F.coalesce(F.col("_j.isInitialRun"), F.lit(False)).alias("isInitialRun"),
        F.col("_j.scheduledAt").alias("scheduledAt"),
        ok.alias("accepted"),
        F.when(~ok, F.lit(REJECT_REASON)).alias("reject_reason"))


def job_metadata(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """The free ``metadata`` of each payload as a VARIANT, beside the other columns of ``raw``.

    Null where the payload is no JSON or has none; whatever shape it has, it is kept.
    """
    carry = [c for c in raw.columns if c != value_col]
    return raw.select(*carry, variants.json_field(value_col, "$.metadata").alias("metadata"))


def accepted_jobs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("accepted"))


def dedup_jobs(jobs: DataFrame, order_cols=("arrival",)) -> DataFrame:
    """One task per run id; the earliest arrival wins (stable by ``order_cols``).

    A partial aggregate, so a run id delivered very many times never lands in
    one task whole.
    """
    return latest_per_key(jobs, ["runId"], list(order_cols), newest=False)
