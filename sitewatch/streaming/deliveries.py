"""ST3: newest delivery outcome per webhook, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.ranking import latest_per_key


def delivery_stream(events: DataFrame) -> DataFrame:
    """Streaming aggregate (update mode): per webhook the newest attempt by
    (attempted_at, id) and its outcome.  State is one row per webhook."""
    agg = events.groupBy("webhook_id").agg(
        F.max_by(F.struct("id", "attempted_at", "status_code"), F.struct("attempted_at", "id")).alias("last"))
    return agg.select("webhook_id", F.col("last.id").alias("id"), F.col("last.attempted_at").alias("attempted_at"),
                      F.col("last.status_code").alias("status_code"),
                      labels.delivery_outcome(F.col("last.status_code")).alias("outcome"))


def batch_upsert_writer(path: str):
    """foreachBatch sink for an update-mode aggregate: each micro-batch's
    changed rows go to ``{path}/batch_id=N`` (overwritten on replay)."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_upserts(spark, path: str, key: str) -> DataFrame:
    """Current view of an upsert sink: the row of the newest batch per key."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c != "batch_id"]
    return latest_per_key(df, [key], ["batch_id"], cols).select(*cols)
