"""ST4: jobs arriving on a stream drive whole runs.

The accepted jobs of a micro-batch (ST1) go through ``run_pipeline`` over the tables as the
batch before left them.  What it returns is written first, to folders of the batch: its
documents, outcomes and outbox, the new revisions and artifacts, and the rows of the
buckets of pages, runs and configurations that it touches.  Then those buckets are put in
place (``sources.keyed``); the others stay as they are.  A batch that is replayed after its
results were complete puts the same rows in place again, before that it runs anew over
unchanged tables: either way once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..plans.pipeline import SiteTables, run_pipeline
from ..sources.documents import register
from ..sources.keyed import KeyedTable
from .common import exists, is_written, write_batch
from .jobs import JobIntake

#: What runs change, by key, and what they add; the other tables are read as they are.
KEYS = {"pages": "id", "runs": "id", "configs": "project_id"}
ADDED = ("revisions", "artifacts")


class RunFlow:
    """Tables and results of a stream of jobs under ``out_dir``; the tables begin as ``tables``.

    ``store``, if given, gets the documents as objects (S7).
    """

    def __init__(self, spark: SparkSession, tables: SiteTables, out_dir: str, now, public_base: str,
                 max_pages: int = S.DEFAULT_MAX_PAGES_JOB, store: str | None = None, buckets: int = 64):
        self.spark, self.out_dir, self.now, self.public_base = spark, out_dir.rstrip("/"), now, public_base
        self.max_pages, self.store = max_pages, store
        for c, kind in (("updated_at", "timestamp"), ("summary", "string")):
            if c not in tables.runs.columns:
                tables = replace(tables, runs=tables.runs.withColumn(c, F.lit(None).cast(kind)))
        self.start = tables
        self.keyed = {n: KeyedTable(spark, f"{self.out_dir}/tables/{n}", getattr(tables, n).schema, key, "project_id", buckets)
                      for n, key in KEYS.items()}
        for n, table in self.keyed.items():
            if not is_written(spark, table.path):       # a stream that starts again finds its tables
                table.create(getattr(tables, n))
        self.intake = JobIntake(spark, f"{self.out_dir}/jobs")
        register(spark)

    def _added(self, name: str, before: int | None) -> DataFrame:
        first = getattr(self.start, name)
        path = f"{self.out_dir}/{name}"
        if not exists(self.spark, path):
            return first
        later = self.spark.read.schema(StructType(list(first.schema.fields)).add("batch_id", "long")).parquet(path)
        if before is not None:
            later = later.filter(F.col("batch_id") < before)
        return first.unionByName(later.select(*first.columns))

    def tables(self, before: int | None = None) -> SiteTables:
        """The tables as they are now; ``before``: without what that batch or a later one added."""
        return replace(self.start, **{n: t.read() for n, t in self.keyed.items()}, **{n: self._added(n, before) for n in ADDED})

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of ``job_stream``."""
        jobs = self.intake.write(batch, batch_id).select(
            F.col("projectId").alias("project_id"), F.col("url").alias("start_url"), F.col("id").alias("job_id"),
            F.col("runId").alias("run_id"), F.col("isScheduled").alias("is_scheduled"), F.col("isInitialRun").alias("is_initial"))
        if jobs.isEmpty():
            return
        staged = f"{self.out_dir}/staged/batch_id={batch_id}"
        if not is_written(self.spark, f"{staged}/complete"):
            self._run(jobs, batch_id, staged)
        for n, table in self.keyed.items():
            table.replace(self.spark.read.schema(table.stored_schema).parquet(f"{staged}/{n}"))

    def _run(self, jobs: DataFrame, batch_id: int, staged: str) -> None:
        tables = self.tables(before=batch_id)
        # a job may come before its run row
        missing = jobs.select(F.col("run_id").alias("id"), "project_id", F.lit(S.RUN_QUEUED).alias("status")).join(
            tables.runs.select("id"), "id", "left_anti")
        tables = replace(tables, runs=tables.runs.unionByName(missing, allowMissingColumns=True))
        done = run_pipeline(jobs, tables, self.now, self.public_base, self.max_pages, self.store)
        for n, table in self.keyed.items():
            table.merged(done.changed[n]).write.mode("overwrite").parquet(f"{staged}/{n}")
        for n in ADDED:
            write_batch(done.changed[n].select(*getattr(self.start, n).columns), f"{self.out_dir}/{n}", batch_id)
        write_batch(done.documents, f"{self.out_dir}/documents", batch_id)
        write_batch(done.outcomes.drop("document"), f"{self.out_dir}/outcomes", batch_id)
        write_batch(done.outbox, f"{self.out_dir}/outbox", batch_id)
        self.spark.range(1).write.mode("overwrite").parquet(f"{staged}/complete")

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` on ``job_stream``."""
        def run(batch: DataFrame, batch_id: int) -> None:
            self.take(batch, batch_id)
        return run
