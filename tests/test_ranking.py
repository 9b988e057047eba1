"""Skew-safe per-key ordering helpers agree with the window they replace."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewatch.operators.ranking import latest_per_key, rank_within


def _skewed(spark):
    # one hot key holding most rows, plus many small keys; ties on ts broken by id
    rows = [("hot", i % 97, i) for i in range(3000)] + [(f"k{i % 50}", i % 7, 10000 + i) for i in range(500)]
    return spark.createDataFrame(rows, "key string, ts int, id int")


def test_rank_within_matches_row_number(spark):
    df = _skewed(spark)
    order = [F.col("ts").desc(), F.col("id").desc()]
    got = {(r["key"], r["id"]): r["rank"] for r in rank_within(df, ["key"], order, "rank", num_partitions=6).collect()}
    w = Window.partitionBy("key").orderBy(*order)
    want = {(r["key"], r["id"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_latest_per_key_matches_top1(spark):
    df = _skewed(spark)
    got = {r["key"]: r["id"] for r in latest_per_key(df, ["key"], ["ts", "id"]).collect()}
    w = Window.partitionBy("key").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = {r["key"]: r["id"] for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == want
