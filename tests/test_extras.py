"""Validators (X1), event types (X3) and free metadata."""

from pyspark.sql import functions as F

from sitewatch.functions import variants
from sitewatch.operators import validators, webhooks
from sitewatch.sources import jobs, tables

HEADS = "project_id string, url string, status_code int, etag string, last_modified string, body string"
STORED = "project_id string, url string, etag string, last_modified string, content_sha256 string"
CASES = [  # status, new etag, new time, old etag, old time, old hash, reason
    (200, '"a"', None, '"a"', None, "h", validators.REASON_ETAG),
    (200, 'W/"a"', None, ' w/"a" ', "t", "h", validators.REASON_ETAG),
    (200, '"a"', "t", '"b"', "t", "h", None),               # ETags decide where there are two
    (200, None, "t", '"b"', " t", "h", validators.REASON_LAST_MODIFIED),
    (200, "", "t", "W/", "t", "h", validators.REASON_LAST_MODIFIED),
    (200, None, "", None, "", "h", None), (200, None, "t", None, "u", "h", None), (200, None, None, None, None, "h", None),
    (200, '"a"', None, '"a"', None, "", None), (200, '"a"', None, '"a"', None, None, None), (404, '"a"', None, '"a"', None, "h", None),
]


def test_what_validators_prove(spark):
    heads = spark.createDataFrame([("p", f"u{i}", c[0], c[1], c[2], "b") for i, c in enumerate(CASES)] + [("p", "new", 200, '"a"', "t", "b")], HEADS)
    stored = spark.createDataFrame([("p", f"u{i}", c[3], c[4], c[5]) for i, c in enumerate(CASES)], STORED)
    decided = validators.header_prefilter(heads, stored)
    got = {r["url"]: (r["reason"], r["read"]) for r in decided.collect()}
    assert got == {f"u{i}": (c[6], c[6] is None) for i, c in enumerate(CASES)} | {"new": (None, True)}
    assert {r["change_reason"] for r in validators.unread_changes(decided).collect()} == {validators.REASON_ETAG, validators.REASON_LAST_MODIFIED}


def test_bodies_of_the_rest_are_not_read(spark, tmp_path):
    rows = [(f"p{n}", f"u{i}", 200, f'"{i}"', None, f"body {i}") for n in range(40) for i in range(3)]
    tables.write_snapshot(spark.createDataFrame(rows, HEADS), f"{tmp_path}/s", buckets=32)
    snapshot = spark.read.parquet(f"{tmp_path}/s")
    stored = spark.createDataFrame([(p, u, '"x"' if (p, u) == ("p7", "u1") else e, None, "h") for p, u, _, e, _, _ in rows], STORED)
    decided = validators.header_prefilter(snapshot, stored)
    schemas = [x for x in decided._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:] if "status_code" in x.split("\n")[0]]
    assert schemas and not any("body" in x.split("\n")[0] for x in schemas)
    found = validators.bodies_to_read(spark, f"{tmp_path}/s", decided, buckets=32)
    assert [(r["project_id"], r["url"], r["body"]) for r in found.collect()] == [("p7", "u1", "body 1")]
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:] if "body" in x.split("ReadSchema: ")[1].split("\n")[0])
    assert "bucket" in scan.split("PartitionFilters: ")[1].split("]")[0]


def test_event_types(spark):
    hooks = spark.createDataFrame([(1, "p", "a", True, ["x", "y", "x"]), (2, "p", "b", True, None), (3, "p", "c", False, ["x"]), (4, "q", "d", True, [])],
                                  "id long, project_id string, url string, is_active boolean, event_types array<string>")
    events = spark.createDataFrame([("p", "x"), ("p", "run.complete"), ("q", "x"), ("p", None)], "project_id string, event_type string")
    got = {(r["event_type"], r["webhook_id"]) for r in webhooks.notify(events, webhooks.subscriptions(hooks)).collect()}
    assert got == {("x", 1), ("run.complete", 2)}
    plain = webhooks.subscriptions(hooks.drop("event_types"))
    assert {(r["id"], r["event_type"]) for r in plain.collect()} == {(1, "run.complete"), (2, "run.complete"), (4, "run.complete")}


def test_metadata_of_any_shape(spark):
    shapes = ['{"a": {"b": [1, "two", null]}}', "[1, 2]", '"text"', "7", "null"]
    raw = spark.createDataFrame([(f'{{"id": "j", "metadata": {s}}}',) for s in shapes] + [('{"id": "j"}',), ("{",), (None,)], "value string")
    found = jobs.job_metadata(raw.withColumn("n", F.monotonically_increasing_id())).orderBy("n")
    rows = found.select(variants.as_json("metadata").alias("j"), variants.field("metadata", "$.a.b[1]").alias("s"),
                        variants.field("metadata", "$.a.b[0]", "int").alias("i"), variants.field("metadata", "$.a.b[1]", "int").alias("bad")).collect()
    assert [r["j"] for r in rows] == ['{"a":{"b":[1,"two",null]}}', "[1,2]", '"text"', "7", "null", None, None, None]
    assert [(r["s"], r["i"], r["bad"]) for r in rows][:2] == [("two", 1, None), (None, None, None)]
