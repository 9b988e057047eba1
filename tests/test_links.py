from pyspark.sql import functions as F

from sitewatch.operators import links

from conftest import one


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "project_id string, url string, status_code int, body string")


def edges(spark, pairs):
    return spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, url string, link string")


def walk(spark, pairs, depth, start="https://a/0"):
    sites = spark.createDataFrame([("p", start)], "project_id string, start_url string")
    return {(r["url"], r["depth"]) for r in links.depth_limited_frontier(edges(spark, pairs), sites, depth).collect()}


def test_hrefs_as_pages_write_them(spark):
    html = ("<a href=\"/1\">x</a><A\n HREF = '/2'>y</A><a class='>' data-href=\"/no\" href=/3 >z</a><a name=x>n</a><abbr href='/no'>"
            "<a href='/4' href='/no'><!-- <a href='/no'> --><script>'<a href=/no>'</script><link href='/no'><a href=''>e</a>"
            "<a title=\"it's href='/no'\" href=\"/5?a=1&amp;b=2\">")
    df = spark.createDataFrame([(html,)], "body string")
    assert one(df.select(links.hrefs("body").alias("h")), "h") == ["/1", "/2", "/3", "/4", "", "/5?a=1&amp;b=2"]


def test_very_long_tags_and_none(spark):
    long = "<a " + "x" * 200_000 + ' title="' + "y'>" * 50_000 + "\" href='/1'>"
    df = spark.createDataFrame([(long,), ("<a href='" + "z" * 100_000,), ("",), (None,)], "body string")
    assert [r[0] for r in df.select(links.hrefs("body")).collect()] == [["/1"], [], [], None]


def test_edges_are_resolved_and_stay_on_the_host(spark):
    body = ('<a href="b?x=1&amp;y=2#f"><a href="//A/c"><a href="http://a:81/d"><a href="https://sub.a/e"><a href="mailto:x@a">'
            '<a href="#top"><a href="b?x=1&amp;y=2"><a href="ftp://a/f">')
    df = snapshot(spark, [("p", "https://a/0", 200, body), ("p", "https://a/1", 404, body), ("p", "https://a/2", 200, None)])
    got = {(r["url"], r["link"]) for r in links.link_edges(df).collect()}
    assert got == {("https://a/0", x) for x in ("https://a/b?x=1&y=2", "https://A/c", "http://a:81/d")}
    every = {r["link"] for r in links.link_edges(df, any_host=True).collect()}
    assert every == {x for _, x in got} | {"https://sub.a/e"}


def test_depth_and_cycles(spark):
    chain = [(f"https://a/{i}", f"https://a/{i + 1}") for i in range(12)] + [("https://a/12", "https://a/0"), ("https://a/0", "https://a/5")]
    assert walk(spark, chain, 0) == {("https://a/0", 0)}
    assert walk(spark, chain, 2) == {("https://a/0", 0), ("https://a/1", 1), ("https://a/5", 1), ("https://a/2", 2), ("https://a/6", 2)}
    whole = walk(spark, chain, None)
    assert len(whole) == 13 and ("https://a/12", 8) in whole and ("https://a/4", 4) in whole


def test_start_without_scheme_and_unknown(spark):
    assert walk(spark, [("https://a/0", "https://a/1")], 1, "a/0") == {("https://a/0", 0), ("https://a/1", 1)}
    assert walk(spark, [], None) == {("https://a/0", 0)}


def test_depth_of_each_project(spark):
    every = edges(spark, [(f"https://a/{i}", f"https://a/{i + 1}") for i in range(6)])
    all_ = every.unionByName(every.withColumn("project_id", F.lit("q"))).unionByName(every.withColumn("project_id", F.lit("r")))
    sites = spark.createDataFrame([("p", "https://a/0", 2), ("q", "https://a/0", None), ("r", "https://a/0", 0)],
                                  "project_id string, start_url string, crawl_depth int")
    got = links.depth_limited_frontier(all_, sites, 4).groupBy("project_id").agg(F.max("depth").alias("d")).collect()
    assert {(r["project_id"], r["d"]) for r in got} == {("p", 2), ("q", 4), ("r", 0)}


def test_no_level_moves_the_edges(spark):
    from sitewatch.sources.tables import clustered
    table = clustered(edges(spark, [("https://a/0", "https://a/1")]), ["project_id", "url"], "test-edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.join(table.select("project_id", "url").distinct(), ["project_id", "url"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Bucketed: true" in plan
