"""Next-run rules, completion decision table, transitions, robots."""

import datetime as dt

from pyspark.sql import functions as F

from sitewatch.functions import schedule
from sitewatch.operators import robots, runs


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_next_run_rules(spark):
    # 2024-03-17 is a Sunday
    cases = ["2024-03-17 01:00:00", "2024-03-17 02:00:00", "2024-03-18 00:00:00", "2024-03-16 03:00:00"]
    df = spark.createDataFrame([(_ts(c),) for c in cases], "now timestamp")
    rows = df.select("now", schedule.next_run_daily("now").alias("d"), schedule.next_run_weekly("now").alias("w"),
                     schedule.next_run_weekly_api("now").alias("a")).orderBy("now").collect()
    got = {str(r["now"]): (str(r["d"]), str(r["w"]), str(r["a"])) for r in rows}
    assert got["2024-03-17 01:00:00"] == ("2024-03-17 02:00:00", "2024-03-17 02:00:00", "2024-03-24 02:00:00")
    assert got["2024-03-17 02:00:00"] == ("2024-03-18 02:00:00", "2024-03-24 02:00:00", "2024-03-24 02:00:00")
    assert got["2024-03-18 00:00:00"] == ("2024-03-18 02:00:00", "2024-03-24 02:00:00", "2024-03-24 02:00:00")
    assert got["2024-03-16 03:00:00"] == ("2024-03-17 02:00:00", "2024-03-17 02:00:00", "2024-03-17 02:00:00")


def test_completion_decision_table(spark):
    rows = [("1", "p", "COMPLETE_WITH_DIFFS", True, False, None),
            ("2", "p", "COMPLETE_NO_DIFFS", True, False, None),
            ("3", "p", "COMPLETE_NO_DIFFS", False, False, "https://own"),
            ("4", "p", "FAILED", False, False, None),
            ("5", None, "COMPLETE_WITH_DIFFS", False, False, None),
            ("6", "p", "COMPLETE_NO_DIFFS", False, True, None),
            ("7", "q", "COMPLETE_NO_DIFFS", False, False, None)]
    r = spark.createDataFrame(rows, "id string, project_id string, status string, is_scheduled boolean, is_initial boolean, llms_txt_url string")
    latest = spark.createDataFrame([("p", "https://latest"), ("q", "")], "project_id string, latest_url string")
    got = {x["run_id"]: x for x in runs.completion_actions(r, latest).collect()}
    assert (got["1"]["touch_last_run"], got["1"]["schedule_next"], got["1"]["notify"], got["1"]["notify_url"]) == (True, True, True, "https://latest")
    assert (got["2"]["schedule_next"], got["2"]["notify"]) == (True, False)  # scheduled, no diffs: no webhook
    assert (got["3"]["schedule_next"], got["3"]["notify"], got["3"]["notify_url"]) == (False, True, "https://own")
    assert (got["4"]["touch_last_run"], got["4"]["schedule_next"], got["4"]["notify"]) == (True, False, False)
    assert (got["5"]["touch_last_run"], got["5"]["notify"]) == (False, False)
    assert (got["6"]["schedule_next"], got["6"]["notify"]) == (True, True)
    assert got["7"]["notify"] is False  # empty latest URL counts as none


def test_transitions(spark):
    base = spark.createDataFrame([("1", "QUEUED", None, None, None), ("2", "QUEUED", None, None, None)],
                                 "id string, status string, finished_at timestamp, summary string, updated_at timestamp")
    changes = spark.createDataFrame([("1", "IN_PROGRESS", None, None, 1), ("1", "FAILED", "boom", None, 2),
                                     ("2", "FAILED", None, None, 1)],
                                    "run_id string, status string, summary string, finished_at timestamp, seq int")
    got = {r["id"]: r for r in runs.apply_transitions(base, changes, "2024-01-01 00:00:00").collect()}
    assert got["1"]["status"] == "FAILED" and got["1"]["summary"] == "Generation failed: boom"
    assert got["2"]["summary"] == "Generation failed" and str(got["2"]["finished_at"]) == "2024-01-01 00:00:00"


def _allowed(spark, lines, paths, agent="TestBot/1.0"):
    docs = spark.createDataFrame([("p", "\n".join(lines))], "project_id string, body string")
    rules = robots.robots_rules(docs, agent)
    pages = spark.createDataFrame([("p", x) for x in paths], "project_id string, path string")
    return {r["path"]: r["allowed"] for r in robots.robots_filter(pages, rules).collect()}


def test_robots(spark):
    lines = ["User-agent: elsewhere", "Disallow: /", "", "# all", "USER-AGENT: *", "Allow: /shop/open", "Disallow: /shop", "Disallow:", "no rule", "Disallow: /tmp/"]
    want = {"/": True, "/shop/open/1": True, "/shop": False, "/shop/closed": False, "/tmp": True, "/tmp/x": False}
    assert _allowed(spark, lines, list(want)) == want
    own = ["User-agent: *", "Allow: /a", "User-agent: TestBot/1.0", "Disallow: /a/b"]
    assert _allowed(spark, own, ["/a/b", "/c"]) == {"/a/b": True, "/c": True}
    pages = spark.createDataFrame([("site", "/any")], "project_id string, path string")
    none = robots.robots_rules(spark.createDataFrame([], "project_id string, body string"), "x")
    assert robots.robots_filter(pages, none).first()["allowed"] is True
