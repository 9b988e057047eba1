"""Streams: state across micro-batches and restarts, replays, and tables that only change where they must."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sitewatch.plans.pipeline import SiteTables
from sitewatch.sources import sitemaps
from sitewatch.sources.keyed import KeyedTable, overlaid
from sitewatch.streaming import changes, jobs
from sitewatch.streaming.common import run_available_now, state_partitions
from sitewatch.streaming.runs import RunFlow

NOW, BASE = "2024-03-15 12:00:00", "https://files.example.org"
RAW = "value string, received_at timestamp"


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(path)


def payloads(spark, rows, path):
    df = spark.createDataFrame(rows, "value string, t string").selectExpr("value", "cast(t as timestamp) received_at")
    df.repartition(2).write.mode("append").parquet(path)


def job(run, at, **more):
    return json.dumps({"id": "j" + run, "url": "https://p.org", "projectId": "p", "runId": run, **more}), f"2024-01-01 {at}"


def intake(spark, tmp_path, rows, sink):
    payloads(spark, rows, f"{tmp_path}/in")
    raw = spark.readStream.schema(RAW).parquet(f"{tmp_path}/in")
    with state_partitions(spark, 3):
        run_available_now(jobs.job_stream(raw).writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(sink))


def test_intake_loses_and_repeats_nothing(spark, tmp_path):
    table = jobs.JobIntake(spark, f"{tmp_path}/out")
    bad = ("{", "2024-01-01 12:00:00")
    intake(spark, tmp_path, [job("1", "12:00:01", url="later"), job("1", "12:00:00", url="first"), job("", "12:00:00"), bad, bad], table.writer())
    # the stream starts anew from its checkpoint: a late repetition, and a late job
    intake(spark, tmp_path, [job("2", "01:00:00"), job("1", "09:00:00", url="repeated"), job("3", "00:00:00"), job("3", "00:00:00")], table.writer())
    assert sorted((r["runId"], r["url"], r["batch_id"]) for r in table.jobs(jobs.ACCEPTED).collect()) == [
        ("1", "first", 0), ("2", "https://p.org", 1), ("3", "https://p.org", 1)]
    assert sorted((r["runId"], r["url"]) for r in table.jobs(jobs.REPEATED).collect()) == [("1", "later"), ("1", "repeated"), ("3", "https://p.org")]
    rejected = table.jobs(jobs.REJECTED).collect()
    assert len(rejected) == 3 and {r["reject_reason"] for r in rejected} == {"job must contain id+url+project id+run id"}


def test_many_run_ids_are_looked_up_by_sparks_own_dedup(spark, tmp_path):
    table = jobs.JobIntake(spark, f"{tmp_path}/out")
    intake(spark, tmp_path, [job(str(i % 300), f"12:00:0{i // 300}", url=f"u{i // 300}") for i in range(600)] + [job("", "12:00:00")] * 3, table.writer())
    intake(spark, tmp_path, [job(str(i), "11:00:00", url="late") for i in range(290, 310)], table.writer())
    plan = jobs.job_stream(spark.readStream.schema(RAW).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan       # no call to Python a run id
    got = table.jobs(jobs.ACCEPTED).collect()
    assert sorted(int(r["runId"]) for r in got) == list(range(310))
    assert {r["url"] for r in got if int(r["runId"]) < 300} == {"u0"}
    assert table.jobs(jobs.REPEATED).count() == 310 and table.jobs(jobs.REJECTED).count() == 3


FETCH = "project_id string, url string, status_code int, content_sha256 string, seq long, run_id string"


def look(spark, tmp_path, rows, pages=(), revisions=()):
    """What a run of the stream adds for newly arrived fetches."""
    path = f"{tmp_path}/out"
    before = {tuple(r) for r in spark.read.parquet(path).collect()} if os.path.exists(path) else set()
    arrive(spark, rows, FETCH, f"{tmp_path}/in")
    known = spark.createDataFrame(list(pages), "id string, project_id string, url string, current_revision_id string")
    revs = spark.createDataFrame(list(revisions), "id string, page_id string, content_sha256 string")
    found = changes.change_stream(spark.readStream.schema(FETCH).parquet(f"{tmp_path}/in"), known, revs)
    with state_partitions(spark, 3):
        run_available_now(found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", path))
    rows = [r for r in spark.read.parquet(path).collect() if tuple(r) not in before]
    return sorted(rows, key=lambda r: (r["url"], r["seq"], r["run_id"]))


def test_page_states_and_restart(spark, tmp_path):
    pages = [("pg1", "p", "u1", "rev1"), ("pg2", "p", "u2", None), ("pg3", "p", "u3", "gone"), ("pg0", "p", "u4", "rev0"), ("pg4", "p", "u4", "rev4")]
    revisions = [("rev1", "pg1", "a" * 64), ("rev4", "pg4", "")]
    a, b = "a" * 64, "b" * 64
    first = look(spark, tmp_path, [("p", "u1", 200, a, 2, "x"), ("p", "u1", 200, b, 1, "x"), ("p", "u2", 200, a, 1, "x"), ("p", "u3", 404, None, 1, "x"),
                                   ("p", "u4", 200, a, 1, "x"), ("p", "u5", 500, None, 1, "x"), ("p", "u5", 200, a, 2, "y"), ("p", "u5", 200, a, 3, "y")],
                 pages, revisions)
    got = [(r["url"], r["seq"], r["change_class"], r["change_reason"]) for r in first]
    assert got == [
        ("u1", 1, "changed", "Content hash changed: aaaaaaaa... -> bbbbbbbb..."), ("u1", 2, "changed", "Content hash changed: bbbbbbbb... -> aaaaaaaa..."),
        ("u2", 1, "changed", "No previous revision found"), ("u3", 1, "changed", "HTTP 404 on full fetch"), ("u4", 1, "changed", "No stored content hash"),
        ("u5", 1, "new", None), ("u5", 2, "new", None), ("u5", 3, "unchanged", "No changes detected")]
    assert [(r["is_new_page"], r["is_new_revision"]) for r in first[-3:]] == [(True, False), (True, True), (False, False)]
    assert first[4]["page_id"] == "pg4"         # the greater of two ids
    again = look(spark, tmp_path, [("p", "u5", 200, b, 1, "z"), ("p", "u2", 200, a, 9, "z"), ("q", "u2", 200, a, 9, "z")])
    assert [(r["project_id"], r["url"], r["change_class"], r["old_revision_id"]) for r in again if r["project_id"] == "p"] == [
        ("p", "u2", "unchanged", first[2]["revision_id"]), ("p", "u5", "changed", first[6]["revision_id"])]
    assert [r["change_class"] for r in again if r["project_id"] == "q"] == ["new"]


def test_stream_equals_the_batch_operators_turn_by_turn(spark, tmp_path):
    """Random fetches, against J3, J10 and S10 applied fetch by fetch."""
    import random
    from sitewatch.operators import changes as ch
    from sitewatch.operators import crawl
    rnd = random.Random(4)
    hashes = [c * 64 for c in "abc"]
    fetches = [("p", f"u{i}", s, rnd.choice(hashes) if s == 200 else None, n, f"r{n}") for n in range(3) for i in range(12) for s in [rnd.choice([200, 200, 404])]]
    pages = [(f"pg{i}", "p", f"u{i}", f"rev{i}" if i % 3 else None) for i in range(8)]
    revisions = [(f"rev{i}", f"pg{i}", rnd.choice([*hashes, "", None])) for i in range(6)]
    got = {(r["url"], r["seq"]): (r["change_class"], r["change_reason"], r["old_revision_id"]) for r in look(spark, tmp_path, fetches, pages, revisions)}
    known = spark.createDataFrame(pages, "id string, project_id string, url string, current_revision_id string")
    revs = spark.createDataFrame(revisions, "id string, page_id string, content_sha256 string")
    want = {}
    for n in range(3):
        turn = spark.createDataFrame([f[:4] + (None, None) for f in fetches if f[4] == n],
                                     "project_id string, url string, status_code int, content_sha256 string, title string, description string")
        found = ch.classify_changes(turn.select("project_id", "url"), known, revs, turn)
        found = spark.createDataFrame(found.collect(), found.schema)
        want.update({(r["url"], n): (r["change_class"], r["change_reason"], r["old_revision_id"]) for r in found.collect()})
        ids = crawl.dedup_revisions(found.filter("change_class <> 'unchanged' and status_code = 200"), F.lit(f"r{n}"))
        known = spark.createDataFrame(crawl.upsert_pages(known, ids, NOW).collect(), known.schema)
        revs = spark.createDataFrame(revs.collect() + ids.filter("is_new_revision").select("revision_id", "page_id", "content_sha256").collect(), revs.schema)
    assert got == want


def test_a_thousand_fetches_of_one_url_are_one_pass(spark, tmp_path):
    rows = [("p", "u", 200, "ab"[n % 2] * 64, n, "r") for n in range(1000)]
    found = look(spark, tmp_path, rows)
    assert [r["change_class"] for r in found] == ["new"] + ["changed"] * 999
    assert len({r["page_id"] for r in found}) == 1


def test_keyed_table_rewrites_touched_buckets_alone(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("site"), (F.col("id") % 100).cast("string")).alias("project_id"),
                                    F.lit(0).alias("n"))
    table = KeyedTable(spark, f"{tmp_path}/t", rows.schema, "id", "project_id", buckets=128)
    table.create(rows)
    at = {f: os.stat(f).st_mtime_ns for f in files(f"{tmp_path}/t")}
    new = rows.filter("project_id = 'site7'").withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([("new", "site7", 2)], rows.schema))
    table.merged(new).write.parquet(f"{tmp_path}/staged")
    staged = spark.read.schema(table.stored_schema).parquet(f"{tmp_path}/staged")
    for _ in range(2):      # the same rows in place again change nothing
        table.replace(staged)
        got = {r["id"]: r["n"] for r in table.read().collect()}
        assert len(got) == 1001 and got["new"] == 2 and sum(got.values()) == 12
    kept = [f for f in files(f"{tmp_path}/t") if f in at and os.stat(f).st_mtime_ns == at[f]]
    assert len(at) - len(kept) == 1 and staged.count() < 40
    assert sorted(map(tuple, overlaid(rows, new, "id").collect())) == sorted(map(tuple, table.read().collect()))
    table.replace(table.merged(rows.limit(0)))
    assert table.read().count() == 1001


def files(top):
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.startswith("part-")]


def run_tables(spark, snapshot):
    make = spark.createDataFrame
    return SiteTables(
        pages=make([], "id string, project_id string, url string, current_revision_id string"),
        revisions=make([], "id string, page_id string, content_sha256 string"),
        snapshot=make(snapshot, "project_id string, url string, status_code int, body string"),
        runs=make([], "id string, project_id string, status string, finished_at timestamp, created_at timestamp"),
        projects=make([("p", "https://p.org"), ("q", "https://q.org")], "id string, domain string"),
        configs=make([("p", "0 2 * * *", True, None, None), ("q", None, True, None, None)],
                     "project_id string, cron_expression string, is_enabled boolean, last_run_at timestamp, next_run_at timestamp"),
        webhooks=make([], "id string, project_id string, url string, is_active boolean"),
        artifacts=make([], "id string, project_id string, type string, public_url string, created_at timestamp"))


@pytest.mark.parametrize("lost", ["nothing", "before results are complete", "while tables are put in place"])
def test_a_replayed_batch_counts_once(spark, tmp_path, lost, monkeypatch):
    body = f'<urlset xmlns="{sitemaps.SITEMAP_NAMESPACE}"><url><loc>https://p.org/a</loc></url></urlset>'
    snapshot = [("p", "https://p.org/sitemap.xml", 200, body), ("p", "https://p.org", 200, "<title>P</title>"), ("p", "https://p.org/a", 200, "<title>A</title>")]
    flow = RunFlow(spark, run_tables(spark, snapshot), f"{tmp_path}/out", NOW, BASE, store=f"{tmp_path}/store", buckets=4)
    calls = {"replace": 0}
    if lost != "nothing":
        what = KeyedTable.merged if lost.startswith("before") else KeyedTable.replace

        def once(self, rows):
            calls["replace"] += 1
            if calls["replace"] == 2:
                raise RuntimeError("lost")
            return what(self, rows)
        monkeypatch.setattr(KeyedTable, what.__name__, once)
    first = [job("1", "12:00:00", isScheduled=True), job("x", "12:00:00", projectId="none")]
    if lost == "nothing":
        intake(spark, tmp_path, first, flow.writer())
    else:
        with pytest.raises(Exception, match="lost"):
            intake(spark, tmp_path, first, flow.writer())
        intake(spark, tmp_path, [], flow.writer())       # the stream starts anew and replays the batch
    intake(spark, tmp_path, [job("2", "13:00:00"), job("1", "12:00:00")], flow.writer())
    now = flow.tables()
    runs = {r["id"]: r["status"] for r in now.runs.collect()}
    assert {r: runs[r] for r in ("1", "2", "x")} == {"1": "COMPLETE_WITH_DIFFS", "2": "COMPLETE_NO_DIFFS", "x": "FAILED"}
    assert len(runs) == 4 and sorted(runs.values())[-1] == "QUEUED"      # the next scheduled one
    assert sorted(r["url"] for r in now.pages.collect()) == ["https://p.org", "https://p.org/a"]
    assert now.revisions.count() == 2 and now.artifacts.count() == 1
    assert [r["run_id"] for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()] == ["1"]
    assert {r["project_id"]: str(r["next_run_at"]) for r in now.configs.collect()} == {"p": "2024-03-16 02:00:00", "q": "None"}
    assert os.listdir(f"{tmp_path}/store") == ["llms_j1.txt"]
    assert open(f"{tmp_path}/store/llms_j1.txt").read().startswith("# P\n")
