"""Test views over the driver's tables (``fx_*``), built with the DataFrame API.

Each view re-shapes a whole driver table into one table of the data model.  The
modulo literals only decide which branch a row falls into (fetch failed, 404,
no stored hash, ...); no view samples or caps its input table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ranking import rank_within
from ..sources.tables import read_table


class Fixtures:
    """Lazily built ``fx_*`` DataFrames for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # --- crawl side -------------------------------------------------------
    @cached_property
    def base(self) -> DataFrame:
        pid = F.col("page_id")
        html = F.col("html")
        body = F.when(pid % 10 == 0, F.regexp_replace(html, "<title>.*?</title>", "<title></title>")).otherwise(html)
        body = F.replace(body, F.lit("</title>"), F.when(
            pid % 3 != 0,
            F.concat(F.lit('</title><meta data-name="description" content="decoy"><meta name="description" content=" Page '), pid.cast("string"),
                     F.lit(' summary ">'))).otherwise(F.lit("</title>")))
        body = F.replace(body, F.lit("</body>"), F.when(
            pid % 4 == 0, F.lit('<noscript>ns</noscript><iframe src="x">if</iframe></body>'))
            .otherwise(F.lit("</body>")))
        # references, a bare "<" and "&", ">" in quotes; a script that is never closed
        body = F.replace(body, F.lit("</body>"), F.when(
            pid % 6 == 1, F.lit('<p data-x="a>b">caf&eacute; &#8217; R&D 5 < 6&nbsp;x &notit; &ltimes;</p></body>'))
            .when(pid % 6 == 4, F.lit('<script>var t = "leak";</body>')).otherwise(F.lit("</body>")))
        return self.table("pages").select(
            "page_id",
            F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("project_id"),
            F.regexp_replace("url", "#.*$", "").alias("url"),
            F.when(pid % 23 == 0, 404).when(pid % 29 == 0, 500).otherwise(200).alias("status_code"),
            body.alias("body"))

    @cached_property
    def fetch(self) -> DataFrame:
        return self.base.filter(F.col("page_id") % 31 != 0).select(
            "page_id", "project_id", "url", "status_code", "body")

    @cached_property
    def linked_fetch(self) -> DataFrame:
        """``fetch`` with links between the pages of a site.

        A site's URLs in order of URL, from 0, are a binary tree: page i names pages 2i+1
        and 2i+2, in the forms that pages write links in, and the start page again
        (a cycle).  Beside them stand links to other hosts, other schemes and
        to the page itself, and anchors in comments and scripts.
        """
        ranked = rank_within(self.base.select("project_id", "url").distinct(), ["project_id"], [F.col("url")], "i")
        urls_ = ranked.withColumn("i", F.col("i") - 1)
        child = urls_.filter("i > 0").select("project_id", F.expr("(i - 1) div 2").alias("i"), F.col("i").alias("k"), F.col("url").alias("to"))
        scheme = "^(https?):.*$"
        same = F.regexp_replace("to", scheme, "$1") == F.regexp_replace("url", scheme, "$1")
        to, k = F.replace("to", F.lit("&"), F.lit("&amp;")), F.when(same, F.col("k") % 5).otherwise(0)
        rooted = F.regexp_replace(to, "^https?://[^/]*", "")
        link = (F.when(k == 0, F.concat(F.lit('<a class="x" href="'), to, F.lit('">a</a>')))
                .when(k == 1, F.concat(F.lit("<A title='>' data-href=\"/no\" HREF = '"), rooted, F.lit("'>b</A>")))
                .when(k == 2, F.concat(F.lit("<a\nhref="), rooted, F.lit(">c</a>")))
                .when(k == 3, F.concat(F.lit('<a href=" '), rooted, F.lit('#top " rel=next>d</a>')))
                .otherwise(F.concat(F.lit('<a href="'), F.regexp_replace(to, "^https?:", ""), F.lit('">e</a>'))))
        tree = (urls_.join(child, ["project_id", "i"], "left").groupBy("project_id", "url", "i")
                .agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("links")))
        first = urls_.filter("i = 0").select("project_id", F.col("url").alias("start"))
        noise = ('<a href="#here">f</a><a href="mailto:a@b.example">g</a><a href="https://other.example/x">h</a><a name="n">i</a>'
                 '<!-- <a href="/hidden">j</a> --><script>var s = "<a href=\'/script\'>";</script>')
        more = F.concat(F.col("links"), F.lit(noise + '<a href="'), F.replace("start", F.lit("&"), F.lit("&amp;")), F.lit('">k</a></title>'))
        return (self.fetch.join(tree.join(first, "project_id"), ["project_id", "url"])
                .withColumn("body", F.concat(more, "body")).drop("links", "i", "start"))

    @cached_property
    def pages(self) -> DataFrame:
        pid = F.col("page_id")
        return self.base.filter(pid % 5 != 0).select(
            F.concat(F.lit("pg_"), pid.cast("string")).alias("id"), "project_id", "url",
            F.when(pid % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("rev_"), pid.cast("string"))).alias("current_revision_id"))

    @cached_property
    def revisions(self) -> DataFrame:
        pid = F.col("page_id")
        h = (F.when(pid % 11 == 0, F.lit(None).cast("string"))
             .when(pid % 13 == 0, F.lit(""))
             .when(pid % 3 == 0, F.sha2(F.lit("old"), 256))
             .otherwise(text.fingerprint("body")))
        return self.base.filter((pid % 5 != 0) & (pid % 7 != 0) & (pid % 17 != 0)).select(
            F.concat(F.lit("rev_"), pid.cast("string")).alias("id"),
            F.concat(F.lit("pg_"), pid.cast("string")).alias("page_id"),
            h.alias("content_sha256"))

    # validators of the fetched and of the stored pages
    @cached_property
    def fetch_with_validators(self) -> DataFrame:
        pid = F.col("page_id")
        tag = F.concat(F.lit('"v'), pid.cast("string"), F.lit('"'))
        return self.fetch.withColumns({
            "etag": F.when(pid % 4 == 0, F.concat(F.lit("W/"), tag)).when(pid % 4 == 1, tag),
            "last_modified": F.when(pid % 3 != 0, F.concat(F.lit("Mon, 01 Jan 2024 00:00:"), F.lpad((pid % 60).cast("string"), 2, "0"), F.lit(" GMT")))})

    @cached_property
    def stored_validators(self) -> DataFrame:
        """Of the pages with a current revision: the validators of its fetch, some of them others by now."""
        heads = self.fetch_with_validators.select("page_id", "url", "etag", "last_modified")
        rev = self.revisions.select(F.col("page_id").alias("id"), "content_sha256")
        pid = F.col("page_id")
        return (self.pages.join(rev, "id").select(F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("page_id"), "project_id", "content_sha256")
                .join(heads, "page_id").select(
                    "project_id", "url", F.when(pid % 5 == 1, F.lit('"old"')).otherwise(F.replace("etag", F.lit("W/"), F.lit(""))).alias("etag"),
                    F.when(pid % 5 == 2, F.lit("Sun, 31 Dec 2023 00:00:00 GMT")).otherwise(F.col("last_modified")).alias("last_modified"),
                    "content_sha256"))

    @cached_property
    def sitemap(self) -> DataFrame:
        return self.base.filter(F.col("page_id") % 2 == 0).select("project_id", "url")

    @cached_property
    def projects(self) -> DataFrame:
        return self.base.groupBy("project_id").agg(F.min("url").alias("start_url"))

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per project of ``projects``: the run to execute now."""
        return self.projects.select(
            "project_id", "start_url",
            F.concat(F.lit("job_"), F.col("project_id")).alias("job_id"),
            F.concat(F.lit("run_"), F.col("project_id")).alias("run_id"))

    @cached_property
    def all_jobs(self) -> DataFrame:
        """``jobs`` and, for about half of the projects, a second, scheduled run in the same batch."""
        second = self.jobs.filter(F.length("project_id") % 2 == 0).select(
            "project_id", "start_url", F.concat("job_id", F.lit("_2")).alias("job_id"), F.concat("run_id", F.lit("_2")).alias("run_id"),
            F.lit(True).alias("is_scheduled"))
        return self.jobs.withColumn("is_scheduled", F.lit(False)).unionByName(second)

    # --- read model side --------------------------------------------------
    @cached_property
    def webhook_events(self) -> DataFrame:
        et = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("webhook_id"),
            F.lit("run.complete").alias("event_type"),
            F.col("props").alias("payload"),
            F.when(et == "purchase", 200).when(et == "click", 204).when(et == "view", 302)
             .when(et == "signup", 404).alias("status_code"),
            F.when(et == "error", F.lit("Request timeout")).alias("response_body"),
            F.col("ts").cast("timestamp").alias("attempted_at"))

    @cached_property
    def webhooks(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            u.alias("id"),
            (u % 50).alias("project_id"),
            F.concat(F.lit("https://hook.example/"), u.cast("string")).alias("url"),
            (u % 4 != 0).alias("is_active"))

    @cached_property
    def runs(self) -> DataFrame:
        o = self.table("orders")
        st, pr, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
        status = (F.when(st == "F", "COMPLETE_WITH_DIFFS").when(st == "O", "COMPLETE_NO_DIFFS")
                  .when(pr == "1-URGENT", "IN_PROGRESS").when(pr == "5-LOW", "FAILED").otherwise("QUEUED"))
        created = F.col("o_orderdate").cast("timestamp")
        return o.select(
            key.alias("id"),
            F.col("o_custkey").alias("project_id"),
            status.alias("status"),
            created.alias("created_at"),
            F.when((st != "P") & (key % 5 != 0), created + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
            (key % 3 == 0).alias("is_scheduled"))

    @cached_property
    def projects_tbl(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").alias("created_by"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("https://"), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))),
                     F.lit(".example.com")).alias("domain"))

    @cached_property
    def project_configs(self) -> DataFrame:
        c = self.table("customer")
        seg = F.col("c_mktsegment")
        cron = (F.when(seg == "BUILDING", "0 2 * * *").when(seg == "MACHINERY", "0 2 * * 0")
                .when(seg == "FURNITURE", "5 4 * * *"))
        return c.filter(F.col("c_custkey") % 10 != 0).select(
            F.col("c_custkey").alias("project_id"),
            F.lit(2).alias("crawl_depth"),
            cron.alias("cron_expression"),
            (F.col("c_acctbal") >= 0).alias("is_enabled"))

    @cached_property
    def artifacts(self) -> DataFrame:
        li = self.table("lineitem")
        ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
        return li.select(
            (ok * 10 + ln).alias("id"),
            ok.alias("run_id"),
            F.when(F.col("l_returnflag") == "A", "JSON").otherwise("LLMS_TXT").alias("type"),
            F.when(ln % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("https://store.example/public/llms_"), ok.cast("string"), F.lit(".txt")))
             .alias("public_url"),
            F.when(ln % 2 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("s3://llms-txt/llms_"), ok.cast("string"), F.lit(".txt")))
             .alias("storage_path"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"))

    # --- sitemap and robots documents (S2-S4, F1, F2) -----------------------
    SITEMAP_PAGE = 20       # URLs of one urlset document, about
    SITEMAP_HOPS = 5        # indexes that only name the next one, in front of kind 0

    @cached_property
    def sitemap_snapshot(self) -> DataFrame:
        """Fetched sitemap documents built from ``fx_sitemap``.

        At every size alike, a project's URLs are dealt by hash into urlsets of
        about ``SITEMAP_PAGE`` (split once more by ``length(url) % 2``), which a
        binary tree of indexes names: index i names its urlsets and the indexes
        2i+1 and 2i+2, and index 0 the root again (a cycle).  By
        ``length(project_id) % 4``: 0 = the root leads to index 0 over a chain
        of indexes, 1 = urlsets with a comment, a stylesheet line or prefixed
        names, 2 = the root is answered with 404, 3 = the urlsets of odd URL
        lengths are malformed (unclosed).
        """
        from ..functions import urls as U
        from ..sources import sitemaps as SM
        origin = F.concat(U.url_part("start_url", "scheme"), F.lit("://"), U.url_part("start_url", "netloc"))
        sizes = self.sitemap.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / self.SITEMAP_PAGE).cast("int").alias("parts"))
        sites = (self.projects.join(sizes, "project_id")
                 .select("project_id", "parts", origin.alias("origin"), SM.sitemap_location("start_url").alias("root"),
                         (F.length("project_id") % 4).alias("kind")))
        name = lambda kind, i: F.concat(F.col("origin"), F.lit(f"/{kind}-"), i.cast("string"), F.lit(".xml"))
        half = F.when(F.length("url") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
        sets = (self.sitemap.join(sites, "project_id")
                .withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")).cast("int")).withColumn("half", half)
                .groupBy("project_id", "origin", "kind", "part", "half").agg(F.array_sort(F.collect_list("url")).alias("u")))
        plain = SM.urlset_document(F.col("u"))
        prefixed = F.regexp_replace(F.replace(plain, F.lit("xmlns="), F.lit("xmlns:sm=")), "<(/?)(urlset|url|loc)", "<$1sm:$2")
        variant = F.col("part") % 3
        body = (F.when((F.col("kind") == 3) & (F.col("half") == "b"), F.concat(F.replace(plain, F.lit("</urlset>"), F.lit("")), F.lit("<url><loc>")))
                .when((F.col("kind") == 1) & (variant == 0), F.concat(plain, F.lit("\n<!-- made by a generator -->\n")))
                .when((F.col("kind") == 1) & (variant == 1), prefixed)
                .when(F.col("kind") == 1, F.replace(plain, F.lit("?><"), F.lit('?><?xml-stylesheet type="text/xsl" href="s.xsl"?><!-- c --><')))
                .otherwise(plain))
        set_url = F.concat(name("sitemap", F.col("part")), F.lit("?"), F.col("half"))
        children = sets.select("project_id", set_url.alias("url"), F.lit(200).alias("status_code"), body.alias("body"))
        # the tree of indexes; node -1-h is the chain's hop h
        i = F.col("i")
        hops = F.when(F.col("kind") == 0, F.lit(self.SITEMAP_HOPS)).otherwise(F.lit(0))
        nodes = sites.withColumn("i", F.explode(F.sequence(-hops, F.col("parts") - 1)))
        node_url = F.when(i == -hops, F.col("root")).otherwise(name("sitemap-index", i))
        named = sets.groupBy("project_id", F.col("part").alias("i")).agg(F.array_sort(F.collect_list(set_url)).alias("sets"))
        more = F.filter(F.array(2 * i + 1, 2 * i + 2), lambda x: x < F.col("parts"))
        next_ = (F.when(i < 0, F.array(name("sitemap-index", i + 1)))
                 .otherwise(F.concat(F.coalesce("sets", F.array().cast("array<string>")),
                                     F.transform(more, lambda x: name("sitemap-index", x)),
                                     F.when(i == 0, F.array(F.col("root"))).otherwise(F.array().cast("array<string>")))))
        indexes = nodes.join(named, ["project_id", "i"], "left").select(
            "project_id", node_url.alias("url"), F.when((F.col("kind") == 2) & (i == 0), 404).otherwise(200).alias("status_code"),
            SM.index_document(next_).alias("body"))
        return children.unionByName(indexes)

    @cached_property
    def sitemap_sets(self) -> DataFrame:
        """The urlset documents of ``sitemap_snapshot``."""
        return self.sitemap_snapshot.filter(F.col("url").rlike(r"/sitemap-[0-9]+\.xml\?[ab]$"))

    ROBOTS_AGENT = "sitewatch-bot"

    @cached_property
    def robots_snapshot(self) -> DataFrame:
        """A robots.txt per project (404 when ``length(project_id) % 3 = 0``)."""
        from ..functions import urls as U
        body = F.concat(F.lit("# robots for "), F.col("project_id"), F.lit(
            "\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow:\n"
            "  Allow: /de/2  \nDisallow: /de/\nno colon here\nUser-agent: sitewatch-bot\nDisallow: /en/9\n"))
        return self.projects.select(
            "project_id", U.well_known("start_url", "robots.txt").alias("url"),
            F.when(F.length("project_id") % 3 == 0, 404).otherwise(200).alias("status_code"), body.alias("body"))
