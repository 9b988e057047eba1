"""Helpers shared by the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from ..session import scratch_table_path

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep large keyed state off the JVM heap unless the cluster chose a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def stream_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    """Fresh input / checkpoint / output folders under the shared checkpoint folder."""
    base = scratch_table_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    return {"input": f"{base}/input", "checkpoint": f"{base}/checkpoint", "output": f"{base}/output"}


def run_available_now(writer) -> None:
    """Start a stream that processes everything available in as many
    micro-batches as the source limits ask for, then stops."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


class state_partitions:
    """Context manager: start stateful streams with ``n`` shuffle (= state)
    partitions, restoring the session's value afterwards.

    A stream fixes its number of state partitions in its checkpoint at the first
    start; size it to the cluster (default: the default parallelism) instead of
    inheriting a batch-oriented setting.
    """

    def __init__(self, spark: SparkSession, n: int | None = None):
        self.spark = spark
        self.n = n or spark.sparkContext.defaultParallelism
        self.prev = None

    def __enter__(self):
        self.prev = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.prev)
        return False


def write_batch(df: DataFrame, out_dir: str, batch_id: int) -> None:
    """A batch's rows in a folder of its own, overwritten as a whole when the batch is replayed."""
    df.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_written(spark: SparkSession, path: str) -> bool:
    """True once a write to ``path`` has been committed."""
    return exists(spark, f"{path}/_SUCCESS")
