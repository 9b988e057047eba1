"""Whole runs over small tables, and site maps as they come."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sitewatch.plans.pipeline import SiteTables, run_pipeline
from sitewatch.sources import sitemaps

NOW, BASE = "2024-03-15 12:00:00", "https://files.example.org"
NS = f'xmlns="{sitemaps.SITEMAP_NAMESPACE}"'


def tables(spark, snapshot, pages=(), revisions=(), runs=()):
    make = spark.createDataFrame
    return SiteTables(
        pages=make(list(pages), "id string, project_id string, url string, current_revision_id string"),
        revisions=make(list(revisions), "id string, page_id string, content_sha256 string"),
        snapshot=make(snapshot, "project_id string, url string, status_code int, body string"),
        runs=make([(r, "p", "QUEUED", None, None) for r in runs], "id string, project_id string, status string, summary string, finished_at timestamp"),
        projects=make([("p", "https://p.org")], "id string, domain string"),
        configs=make([("p", "0 2 * * *", True, None, None, None)], "project_id string, cron_expression string, is_enabled boolean, last_run_at timestamp, next_run_at timestamp, crawl_depth int"),
        webhooks=make([("w", "p", "https://hook", True)], "id string, project_id string, url string, is_active boolean"),
        artifacts=make([], "id string, project_id string, type string, public_url string, created_at timestamp"))


def page(title):
    return f"<html><head><title>{title}</title></head><body>{title}</body></html>"


def site(*urls, fail=()):
    body = "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    rows = [("p", "https://p.org/sitemap.xml", 200, f"<urlset {NS}>{body}</urlset>")]
    return rows + [("p", u, 500 if u in fail else 200, page(u[-1])) for u in urls]


def test_two_runs_of_a_site_in_one_batch(spark):
    urls = ["https://p.org", "https://p.org/a", "https://p.org/b"]
    jobs = spark.createDataFrame([("p", "https://p.org", "j1", "r1", False, False), ("p", "https://p.org", "j2", "r2", True, False)],
                                 "project_id string, start_url string, job_id string, run_id string, is_scheduled boolean, is_initial boolean")
    done = run_pipeline(jobs, tables(spark, site(*urls), runs=("r1", "r2", "other")), NOW, BASE)
    runs = {r["id"]: r for r in done.tables.runs.collect()}
    assert runs["r1"]["status"] == "COMPLETE_WITH_DIFFS" and runs["r2"]["status"] == "COMPLETE_NO_DIFFS"
    assert runs["other"]["status"] == "QUEUED" and runs["other"]["finished_at"] is None
    assert [r["run_id"] for r in done.documents.collect()] == ["r1"]
    assert sorted(r["url"] for r in done.tables.pages.collect()) == urls
    assert done.tables.revisions.count() == 3 and done.tables.artifacts.count() == 1
    # the scheduled run without changes tells nobody, but plans the next one
    assert [r["run_id"] for r in done.outbox.collect()] == ["r1"]
    assert [(r["project_id"], r["status"]) for r in done.scheduled.collect()] == [("p", "QUEUED")] and len(runs) == 4
    config = done.tables.configs.first()
    assert str(config["last_run_at"]) == NOW and str(config["next_run_at"]) == "2024-03-16 02:00:00"


def test_a_later_run_takes_what_the_first_left(spark):
    urls = [f"https://p.org/{c}" for c in "abcd"]
    jobs = spark.createDataFrame([("p", "https://p.org/a", f"j{i}", f"r{i}") for i in range(3)], "project_id string, start_url string, job_id string, run_id string")
    done = run_pipeline(jobs, tables(spark, site(*urls, fail=urls[3:]), runs=("r0", "r1", "r2")), NOW, BASE, max_pages=2)
    docs = {r["run_id"]: r["document"] for r in done.documents.collect()}
    lines = {r: [x for x in d.split("\n") if x.startswith("- ")] for r, d in docs.items()}
    # the failing page is new in every run and never gets a line
    assert {r: len(x) for r, x in lines.items()} == {"r0": 2, "r1": 1, "r2": 0}
    assert sorted(r["url"] for r in done.tables.pages.collect()) == urls[:3]


@pytest.mark.parametrize("body, want", [
    (f"<urlset {NS}><url><loc>u</loc></url></urlset>\n<!-- made by x -->\n", ["url u"]),
    (f'<?xml version="1.0"?><?xml-stylesheet href="s"?><sitemapindex {NS}><sitemap><loc>c</loc></sitemap></sitemapindex>', ["sitemap c"]),
    (f"<!-- c --><s:urlset {NS.replace('xmlns', 'xmlns:s')}><s:url><s:loc>u&amp;v</s:loc></s:url></s:urlset>", ["url u&v"]),
    (f"<urlset {NS}><url><loc>u</loc></url>", []), (f"<urlset {NS}><url><loc>u</url></loc></urlset>", []),
    ("<urlset><url><loc>u</loc></url></urlset>", []), (f"<urlset {NS}></urlset>", []), ("<html></html>", []), ("", []), (None, []),
])
def test_site_map_documents(spark, body, want):
    docs = spark.createDataFrame([("p", "d", body)], "project_id string, url string, body string")
    assert [f"{r['kind']} {r['loc']}" for r in sitemaps.parse_entries(docs).collect()] == want


def test_deep_and_circular_indexes(spark):
    def index(*locs):
        return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    chain = [("p", f"i{n}", 200, index(f"i{n + 1}", "i0")) for n in range(9)]
    rows = chain + [("p", "i9", 200, index("set", "gone", "i3")), ("p", "set", 200, f"<urlset {NS}><url><loc>https://u</loc></url></urlset>"),
                    ("p", "gone", 404, f"<urlset {NS}><url><loc>https://v</loc></url></urlset>"), ("q", "set", 200, "other site")]
    snapshot = spark.createDataFrame(rows, "project_id string, url string, status_code int, body string")
    root = snapshot.filter("url = 'i0'")
    assert [tuple(r) for r in sitemaps.expand_index(root, snapshot).collect()] == [("p", "https://u")]


def test_no_jobs_leave_the_tables(spark):
    given = tables(spark, site("https://p.org"), pages=[("pg", "p", "https://p.org", None)], runs=("r",))
    jobs = spark.createDataFrame([], "project_id string, start_url string, job_id string, run_id string")
    done = run_pipeline(jobs, given, NOW, BASE)
    assert [r["id"] for r in done.tables.pages.collect()] == ["pg"] and [r["status"] for r in done.tables.runs.collect()] == ["QUEUED"]
    for df in (done.documents, done.outcomes, done.actions, done.outbox, done.scheduled, done.changes, *done.changed.values()):
        assert df.count() == 0


def test_a_failing_site_stops_no_other(spark, tmp_path):
    urls = ["https://p.org", "https://p.org/a"]
    long = "j" * 300
    rows = [("p", "https://p.org", "j1", "r1"), ("gone", "https://gone.org", "j2", "r2"), ("p", "not an address", "j3", "r3"), ("q", "https://p.org", long, "r4")]
    jobs = spark.createDataFrame([(*r, True, False) for r in rows], "project_id string, start_url string, job_id string, run_id string, is_scheduled boolean, is_initial boolean")
    given = tables(spark, site(*urls) + [("q", u, s, b) for _, u, s, b in site(*urls)], runs=("r1", "r2", "r3", "r4"))
    given = replace(given, projects=given.projects.unionByName(spark.createDataFrame([("q", "https://q.org")], "id string, domain string")))
    done = run_pipeline(jobs, given, NOW, BASE, store=str(tmp_path / "store"))
    runs = {r["id"]: r for r in done.tables.runs.collect()}
    assert {i: runs[i]["status"] for i in ("r1", "r2", "r3", "r4")} == {"r1": "COMPLETE_WITH_DIFFS", "r2": "FAILED", "r3": "FAILED", "r4": "FAILED"}
    assert runs["r2"]["summary"] == "Generation failed: Project not found: gone"
    assert runs["r3"]["summary"] == "Generation failed: Invalid URL: not an address"
    assert runs["r4"]["summary"].startswith("Generation failed: Document could not be written: llms_jjj")
    assert all(str(runs[r]["finished_at"]) == NOW for r in ("r1", "r2", "r3", "r4"))
    actions = {r["run_id"]: r for r in done.actions.collect()}
    assert all(actions[r]["touch_last_run"] and not actions[r]["schedule_next"] and not actions[r]["notify"] for r in ("r2", "r3", "r4"))
    assert [r["run_id"] for r in done.outbox.collect()] == ["r1"] and done.tables.artifacts.count() == 1
    assert os.listdir(tmp_path / "store") == ["llms_j1.txt"]
    # the address is read, as for any run, though its document got lost
    assert {r["project_id"] for r in done.tables.pages.collect()} == {"p", "q"}


def test_links_of_the_project_s_depth_are_found(spark):
    def linking(*to):
        return "<title>t</title>" + "".join(f"<a href='{x}'>l</a>" for x in to)
    rows = [("p", "https://p.org", 200, linking("/a")), ("p", "https://p.org/a", 200, linking("b")), ("p", "https://p.org/b", 200, linking("/c")),
            ("p", "https://p.org/c", 200, linking())]
    jobs = spark.createDataFrame([("p", "https://p.org", "j", "r")], "project_id string, start_url string, job_id string, run_id string")
    given = tables(spark, rows, runs=("r",))

    def found(**kw):
        return sorted(r["url"][len("https://p.org"):] for r in run_pipeline(jobs, given, NOW, BASE, **kw).tables.pages.collect())
    assert found() == [""] and found(follow_links=True) == ["", "/a", "/b"]
    given = replace(given, configs=given.configs.withColumn("crawl_depth", F.lit(1)))
    assert found(follow_links=True) == ["", "/a"]
