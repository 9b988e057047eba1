"""Objects, bucketed tables, the Bloom filter and the revisions that it is for."""

import os

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import bloom, changes as ch, crawl, index
from sitewatch.sources import documents, tables


def test_each_document_is_the_object_its_row_names(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = [("p", "r1", "a b+c%20é", "# A\n\nüber\r\n"), ("q", "r2", "j2", ""), ("s", "r3", "x/y", "no name"), ("t", "r4", "n" * 300, "too long")]
    docs = spark.createDataFrame(rows, "project_id string, run_id string, job_id string, document string").repartition(3)
    for _ in range(2):      # a run that is repeated leaves one object each
        index.write_documents(docs, store)
    assert sorted(os.listdir(store)) == ["llms_a b+c%20é.txt", "llms_j2.txt"]
    made = {r["run_id"]: r for r in index.artifact_rows(docs, "2024-01-01 00:00:00", "https://x", store).collect()}
    for run in ("r1", "r2"):
        with open(made[run]["storage_path"], "rb") as f:
            assert f.read().decode() == dict((r[1], r[3]) for r in rows)[run]
        assert os.path.getsize(made[run]["storage_path"]) == made[run]["size_bytes"]
    assert {tuple(r) for r in documents.object_names(spark, store).collect()} == {("llms_a b+c%20é.txt", 12)}
    assert {tuple(r) for r in documents.read_objects(spark, store).collect()} == {("llms_a b+c%20é.txt", "# A\n\nüber\r\n")}


def test_writer_leaves_nothing_unfinished(tmp_path):
    writer = documents.DocumentWriter(str(tmp_path))
    done = writer.write(iter([{"file_name": "a", "document": "1"}, {"file_name": "..", "document": "2"}]))
    assert (done.documents, done.refused) == (1, 1) and len(os.listdir(tmp_path)) == 2
    again = documents.DocumentWriter(str(tmp_path))         # another attempt at the same rows
    again.write(iter([{"file_name": "a", "document": "1"}]))
    writer.commit([done])
    again.abort([None])
    assert os.listdir(tmp_path) == ["a"]


def test_file_uris(tmp_path):
    for path in (f"{tmp_path}/x", f"file:{tmp_path}/y", f"file://{tmp_path}/z/"):
        documents.DocumentWriter(path).write(iter([{"file_name": "a", "document": "ü"}]))
    assert all((tmp_path / d / "a").read_text() == "ü" for d in "xyz")


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_bloom_filter_loses_none_and_lets_few_through(spark, n):
    rows = spark.range(n).select((F.col("id") % 7).cast("string").alias("project_id"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    others = spark.range(100_000).select((F.col("id") % 7).cast("string").alias("project_id"), F.concat(F.lit("v"), F.col("id")).alias("url"))
    key = ["project_id", "url"]
    table = bloom.bloom_filter(rows, key)
    assert bloom.may_hold(rows, key, table).count() == n
    assert bloom.may_hold(others, key, table).count() < 2000
    assert bloom.may_hold(others, key, table).count() + bloom.may_hold(others, key, table, absent=True).count() == 100_000


def test_bloom_filter_beyond_its_size(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 2)
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    assert bloom.may_hold(rows, ["k"], bloom.bloom_filter(rows, ["k"])).count() == 5000


def test_only_fresh_bodies_are_shuffled(spark):
    """The scan's bodies meet the filter by broadcast; an exchange of bodies lies behind it."""
    snap = spark.range(50).select(F.lit("p").alias("project_id"), F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit(200).alias("status_code"),
                                  F.concat(F.lit("<title>t</title>"), F.col("id")).alias("body"))
    digest = ch.digest_snapshot(snap)
    crawled = digest.filter("url in ('u1', 'u2')").select("project_id", "url", F.lit(None).cast("string").alias("page_id"), F.lit("new").alias("change_class"),
                                                          F.lit(None).cast("string").alias("change_reason"), F.lit(None).cast("string").alias("old_revision_id"),
                                                          F.lit(None).cast("string").alias("old_content_sha256"), "content_sha256", "title", "description")
    out = crawl.new_revisions(crawl.dedup_revisions(crawled, F.lit("r")), snap, F.lit("r"), "2024-01-01 00:00:00")
    assert sorted(r["content"][-1] for r in out.collect()) == ["1", "2"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "_block" in below and "rightHint=(strategy=broadcast)" in below


def test_bucketed_tables_join_without_exchange(spark):
    a = tables.clustered(spark.range(100).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("url")), ["project_id", "url"], "a")
    b = tables.clustered(spark.range(50).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("url"), F.lit(1).alias("x")), ["project_id", "url"], "b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, ["project_id", "url"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("x is not null").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_changes_over_tables_laid_out_move_only_what_is_found(spark):
    """J3 over the laid out catalogue and digest: an exchange of the site map's and start URLs alone."""
    from sitewatch.plans.crawl_job import CrawlInputs, CrawlJob
    make = spark.createDataFrame
    rows = [("p", f"https://p/{i}", 404 if i == 3 else 200, f"<p>{i}</p>") for i in range(6)]
    snap = make(rows, "project_id string, url string, status_code int, body string")
    pages = make([(f"pg{i}", "p", f"https://p/{i}", f"rev{i}" if i else None) for i in range(5)] + [("pg9", "p", "https://p/9", None)],
                 "id string, project_id string, url string, current_revision_id string")
    sha = {r["url"][-1]: r["content_sha256"] for r in ch.digest_snapshot(snap).collect()}
    revisions = make([(f"rev{i}", f"pg{i}", sha[str(i)] if i == 1 else "x") for i in range(1, 4)], "id string, page_id string, content_sha256 string")
    found = make([("p", "https://p/1"), ("p", "https://p/5"), ("p", "https://p/7")], "project_id string, url string")
    jobs = make([("p", "p/5", "j", "r")], "project_id string, start_url string, job_id string, run_id string")
    job = CrawlJob(CrawlInputs(found, pages, revisions, snap, jobs))
    plain = sorted(tuple(r) for r in job.changes.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = job.laid_out().changes
        plan = laid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r) for r in laid.select(*job.changes.columns).collect()) == plain
    assert [(r[1][-1], r[3]) for r in plain] == [("0", "changed"), ("1", "unchanged"), ("2", "changed"), ("3", "changed"), ("4", "changed"),
                                                 ("5", "new"), ("7", "new"), ("9", "changed")]
    scans = {line.split("bucketed_")[0] for line in plan.split("\n") if "Bucketed: true" in line}
    assert scans and plan.count("Exchange") == 2        # site map and start URLs: made distinct, and met with the catalogue
