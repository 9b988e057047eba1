"""ST1: continuous job intake -- parse, validate, one task per run id, nothing lost.

Which run ids were accepted is keyed state of the stream (RocksDB), kept by Spark's own
``dropDuplicates``: a micro-batch looks up the run ids it brings and no others, whatever
was accepted before.  Run ids are kept for good, so neither a late job is dropped nor a
late repetition run again.  Beside the jobs the stream brings a mark for each run id that
is new to it; the sink accepts the first job behind the mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.jobs import parse_jobs
from .common import use_rocksdb_state

ACCEPTED, REJECTED, REPEATED = "accepted", "rejected", "repeated"
JOB_SCHEMA = ("id string, url string, projectId string, runId string, isScheduled boolean, isInitialRun boolean, "
              "scheduledAt long, received_at timestamp, reject_reason string")
JOB_FIELDS = [x.split()[0] for x in JOB_SCHEMA.split(", ")]


def job_stream(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """A stream of (value, received_at) as jobs, with ``good``, and rows that only mark a run id: ``is_new``.

    A run id is marked in the micro-batch that brings its first good job, and never again.
    ``with_outcome`` tells a micro-batch's jobs apart.
    """
    use_rocksdb_state(raw.sparkSession)
    parsed = parse_jobs(raw.select(value_col, "received_at"), value_col).withColumn("scheduledAt", F.col("scheduledAt").cast("long"))
    jobs = parsed.select(F.col("accepted").alias("good"), F.lit(False).alias("is_new"), *JOB_FIELDS)
    marks = parsed.filter("accepted").select("runId").dropDuplicates(["runId"])
    return jobs.unionByName(marks.withColumns({"good": F.lit(True), "is_new": F.lit(True)}), allowMissingColumns=True)


def with_outcome(batch: DataFrame) -> DataFrame:
    """The jobs of a micro-batch of ``job_stream`` with their ``outcome``.

    Of the jobs of a new run id the earliest (by received_at, id, url, project)
    is accepted; the others, and any later one, are repeated.
    """
    # rejected jobs have no run id to meet at: each is alone
    key = F.when(F.col("good"), F.col("runId")).otherwise(F.monotonically_increasing_id().cast("string"))
    by_run = Window.partitionBy("good", "key").orderBy(F.desc("is_new"), "received_at", "id", "url", "projectId", "scheduledAt", "isScheduled", "isInitialRun")
    first = F.coalesce(F.lag("is_new").over(by_run), F.lit(False))
    outcome = F.when(~F.col("good"), REJECTED).when(first, ACCEPTED).otherwise(REPEATED)
    return batch.withColumn("key", key).withColumn("outcome", outcome).filter(~F.col("is_new")).select(*JOB_FIELDS, "outcome")


class JobIntake:
    """The sink of ``job_stream``: tables under ``out_dir`` by outcome, a folder a micro-batch."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write a micro-batch, overwritten as a whole when it is replayed; its accepted jobs."""
        path = f"{self.out_dir}/batch_id={batch_id}"
        with_outcome(batch).write.mode("overwrite").partitionBy("outcome").parquet(path)
        return self._read(path).filter(F.col("outcome") == ACCEPTED).select(*JOB_FIELDS)

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        def run(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id)
        return run

    def _read(self, path: str, more: str = "") -> DataFrame:
        return self.spark.read.schema(f"{JOB_SCHEMA}, outcome string{more}").parquet(path)

    def jobs(self, outcome: str) -> DataFrame:
        """All jobs of an outcome so far, with their ``batch_id``."""
        return self._read(self.out_dir, ", batch_id long").filter(F.col("outcome") == outcome).drop("outcome")
