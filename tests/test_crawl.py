"""Change classification, crawl budget, revisions and the site index document."""

import random

from pyspark.sql import functions as F

from sitewatch.operators import changes as ch
from sitewatch.operators import crawl, index

CAND_SCHEMA = ("project_id string, url string, page_id string, change_class string, change_reason string, "
               "old_revision_id string, old_content_sha256 string, fetched boolean, status_code int, "
               "content_sha256 string, title string, description string")


def _changes(spark, rows):
    full = [(r + (None,) * 12)[:12] for r in rows]
    return spark.createDataFrame(full, CAND_SCHEMA)


def test_budget_is_a_prefix_of_the_crawl_order(spark):
    """At any budget, beyond the window's group limit too."""
    rnd = random.Random(2)
    sites = [("big", "big.org/home", 2500), ("small", "http://small.org/", 3), ("quiet", "quiet.org", 0)]
    rows, want = [], {}
    for site, start, n in sites:
        home = start if "://" in start else "https://" + start
        pages = [(site, f"https://{site}.org/{i:05d}", None if i % 3 else f"id{i}", "new" if i % 3 else "changed") for i in range(n)]
        pages += [(site, home, "home", "new" if n else "unchanged"), (site, home + "/same", "same", "unchanged")]
        rnd.shuffle(pages)
        rows += pages
        todo = [p for p in pages if p[3] != "unchanged"]
        want[site] = [p[1] for p in sorted(todo, key=lambda p: (p[1] != home, p[3] != "changed", p[1]))]
    changes = _changes(spark, rows).repartition(4)
    projects = spark.createDataFrame([s[:2] for s in sites], "project_id string, start_url string")
    for n in (0, 1, 7, 2000):
        got = {site: [] for site, *_ in sites}
        for r in sorted(crawl.crawl_budget(changes, projects, n).collect(), key=lambda r: r["crawl_rank"]):
            got[r["project_id"]].append(r["url"])
        assert got == {site: urls[:max(n, 1)] for site, urls in want.items()}


def test_one_revision_for_a_url_fetched_twice(spark):
    snap = spark.createDataFrame([("p", "u", 500, "<p>error</p>"), ("p", "u", 200, "<p>good</p>"), ("p", "u", 200, "<p>good</p> ")],
                                 "project_id string, url string, status_code int, body string")
    row = ("p", "u", None, "new", None, None, None, True, 200, ch.digest_snapshot(snap).first()["content_sha256"], "t", "d")
    dedup = crawl.dedup_revisions(_changes(spark, [row]).withColumn("run_id", F.lit("r1")), "run_id")
    got = crawl.new_revisions(dedup, snap, "run_id", "2024-01-01 00:00:00").collect()
    assert len(got) == 1 and got[0]["content"].strip() == "<p>good</p>" and len(got[0]["id"]) == len("rev_") + 64


def test_classification_order_of_checks(spark):
    frontier = spark.createDataFrame([("p", u) for u in ["u1", "u2", "u3", "u4", "u5", "u6", "u7"]],
                                     "project_id string, url string")
    pages = spark.createDataFrame([("pg1", "p", "u1", "r1"), ("pg2", "p", "u2", "r2"), ("pg3", "p", "u3", None),
                                   ("pg4", "p", "u4", "r4"), ("pg5", "p", "u5", "r5"), ("pg6", "p", "u6", "r6")],
                                  "id string, project_id string, url string, current_revision_id string")
    revs = spark.createDataFrame([("r1", "pg1", "h1"), ("r2", "pg2", "h2"), ("r4", "pg4", ""), ("r5", "pg5", "aaaaaaaaaa"),
                                  ("r6", "pg6", "same")], "id string, page_id string, content_sha256 string")
    digest = spark.createDataFrame([("p", "u2", 404, None, None, None), ("p", "u3", 200, "x", "", ""),
                                    ("p", "u4", 200, "x", "", ""), ("p", "u5", 200, "bbbbbbbbbb", "", ""),
                                    ("p", "u6", 200, "same", "", "")],
                                   "project_id string, url string, status_code int, content_sha256 string, title string, description string")
    got = {r["url"]: (r["change_class"], r["change_reason"], r["old_revision_id"])
           for r in ch.classify_changes(frontier, pages, revs, digest).collect()}
    assert got["u1"] == ("changed", "Error checking content hash: fetch failed", "r1")
    assert got["u2"] == ("changed", "HTTP 404 on full fetch", "r2")
    assert got["u3"] == ("changed", "No previous revision found", None)
    assert got["u4"] == ("changed", "No stored content hash", "r4")
    assert got["u5"] == ("changed", "Content hash changed: aaaaaaaa... -> bbbbbbbb...", "r5")
    assert got["u6"] == ("unchanged", "No changes detected", "r6")
    assert got["u7"] == ("new", None, None)
    summary = ch.change_summary(ch.classify_changes(frontier, pages, revs, digest)).collect()[0]
    assert (summary["n_changed"], summary["n_new"], summary["n_unchanged"], summary["total_checked"], summary["has_changes"]) == (5, 1, 1, 7, True)


def test_revision_dedup_keeps_old_id_when_hash_same(spark):
    rows = [("p", "u1", "pg1", "changed", "r", "old1", "r1", "h1", True, 200, "h1"),
            ("p", "u2", "pg2", "changed", "r", "old2", "r2", "h2", True, 200, "h9"),
            ("p", "u3", None, "new", None, None, None, None, True, 200, "h3")]
    df = _changes(spark, [tuple(x for i, x in enumerate(r) if i != 5) for r in rows])
    out = {r["url"]: r for r in crawl.dedup_revisions(df.withColumn("run_id", F.lit("run1")), "run_id").collect()}
    assert out["u1"]["revision_id"] == "r1" and not out["u1"]["is_new_revision"]
    assert out["u2"]["is_new_revision"] and out["u2"]["revision_id"].startswith("rev_")
    assert out["u3"]["is_new_page"] and out["u3"]["page_id"].startswith("pg_")


def _doc(spark, pages, start_url="https://example.com"):
    crawled = spark.createDataFrame(
        [("p", u, t, d, u == start_url, i + 1) for i, (u, t, d) in enumerate(pages)],
        "project_id string, url string, title string, description string, is_start boolean, crawl_rank int")
    projects = spark.createDataFrame([("p", start_url)], "project_id string, start_url string")
    summary = spark.createDataFrame([("p", True)], "project_id string, has_changes boolean")
    crawled = crawled.withColumn("fetched", F.lit(True)).withColumn("status_code", F.lit(200))
    return index.site_index(crawled, projects, summary).collect()[0]["document"]


def test_document(spark):
    pages = [("https://shop.org", " Shop ", "Things to buy"), ("https://shop.org/a", "", "no title"), ("https://shop.org/b", "B", " "), ("", "lost", "x")]
    assert _doc(spark, pages, "https://shop.org").split("\n") == [
        "# Shop", "", "> Things to buy", "", "## Pages", "", "- [Shop](https://shop.org): Things to buy",
        "- [https://shop.org/a](https://shop.org/a): no title", "- [B](https://shop.org/b)"]
    # without the start page its place is taken by the first page; without any, by the address
    assert _doc(spark, pages[2:3], "https://shop.org").split("\n")[:3] == ["# B", "", "> Website content from https://shop.org"]
    assert _doc(spark, [], "https://shop.org:8080/x") == "# shop.org:8080\n\n> Website content from https://shop.org:8080/x\n\n## Pages\n"
