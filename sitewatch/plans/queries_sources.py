"""Registered queries of sources and URL functions: S1 S2 S3 S4 S6 F1 F2 P1
P2 P3 P4 P5 P6 P7 P8 P10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import links, robots, validators
from ..sources import sitemaps as SM
from ..session import materialize
from ..sources import tables
from . import oracle as O
from .fixtures import Fixtures
from .queries import register

HOST_DUCK = r"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)', 1))"
PATH_DUCK = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
ORIGIN_DUCK = r"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


@register("crawl_snapshot", O.with_fx("SELECT project_id, url, status_code, length(body) AS body_chars FROM fx_fetch"))
def q_crawl_snapshot(spark, sf_dir):
    """The fetched pages as a snapshot at rest, read back with its fixed schema."""
    import uuid
    from ..session import scratch_table_path
    path = scratch_table_path(spark, f"snapshot-{uuid.uuid4().hex}")
    tables.snapshot_view(_fx(spark, sf_dir).fetch).write.parquet(path)
    s = tables.read_snapshot(spark, path)
    return s.select("project_id", "url", "status_code", F.length("body").alias("body_chars"))


@register("page_catalogue", O.with_fx("SELECT id, project_id, url, current_revision_id FROM fx_pages"))
def q_page_catalogue(spark, sf_dir):
    return tables.existing_pages(_fx(spark, sf_dir).pages)


@register("ensure_scheme", """SELECT page_id, raw, CASE WHEN raw IS NULL OR raw='' THEN raw WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' THEN raw
   ELSE 'https://' || raw END AS url FROM (SELECT page_id, CASE page_id%4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
   WHEN 2 THEN NULL ELSE '' END AS raw FROM pages)""")
def q_ensure_scheme(spark, sf_dir):
    p = _fx(spark, sf_dir).table("pages")
    pid = F.col("page_id")
    raw = (F.when(pid % 4 == 0, F.col("url")).when(pid % 4 == 1, F.regexp_replace("url", "^https?://", ""))
           .when(pid % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit("")))
    return p.select("page_id", raw.alias("raw")).select("page_id", "raw", urls.ensure_scheme("raw").alias("url"))


# Reference forms of RFC 3986 5.4, and links as pages write them, all seen from LINK_BASE of every site.
LINK_BASE = "/b/c/d;p?q"
LINK_FORMS = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..",
    "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h",
    "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "http://b.com/x/../y", "//c.com/p/./q", "HTTP://b.com/y", "?", " g ",
    "a\tb\nc", "mailto:x@b.com", "tel:+1", "javascript:go()", "ftp://b.com/x", "data:text/plain,x",
]


def _link_values() -> str:
    """SQL rows (form, over https, over http): the standard library's answers with the site left open as {site}."""
    from urllib.parse import urldefrag, urljoin, urlparse

    def answer(scheme: str, form: str) -> str:
        got = urldefrag(urljoin(f"{scheme}://site{LINK_BASE}", form.strip()))[0]
        ok = form and not form.startswith(("mailto:", "tel:", "javascript:")) and urlparse(got).scheme in ("http", "https")
        return "'" + got.replace("//site/", "//{site}/") + "'" if ok else "NULL"

    def quoted(form: str) -> str:
        return " || ".join(f"chr({ord(c)})" if c in "\t\n" else f"'{c}'" for c in form) or "''"

    return ", ".join(f"({quoted(x)}, {answer('https', x)}, {answer('http', x)})" for x in LINK_FORMS)


@register("resolve_links", f"""SELECT page_id, href, {ORIGIN_DUCK.format(u='url')} || href AS resolved FROM
   (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
   UNION ALL SELECT page_id, href, replace(CASE WHEN url LIKE 'https:%' THEN over_https ELSE over_http END, '{{site}}',
   split_part(split_part({ORIGIN_DUCK.format(u='url')}, '://', 2), '/', 1)) FROM pages, (VALUES {_link_values()}) AS l(href, over_https, over_http)""")
def q_resolve_links(spark, sf_dir):
    p = _fx(spark, sf_dir).table("pages")
    hrefs = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href"))
    origin = F.concat(urls.url_part("url", "scheme"), F.lit("://"), urls.url_part("url", "netloc"))
    forms = p.select("page_id", F.concat(origin, F.lit(LINK_BASE)).alias("url"), F.explode(F.array(*map(F.lit, LINK_FORMS))).alias("href"))
    return hrefs.unionByName(forms).select("page_id", "href", urls.resolve_link(F.col("url"), F.col("href")).alias("resolved"))


@register("same_host", f"""SELECT p.page_id, q.page_id AS other_page_id, {HOST_DUCK.format(u='p.url')} IS NOT DISTINCT FROM {HOST_DUCK.format(u='q.url')} AS same_host
   FROM pages p JOIN pages q ON q.page_id = p.page_id + 1""")
def q_same_host(spark, sf_dir):
    p = _fx(spark, sf_dir).table("pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("other_page_id"), F.col("url").alias("other_url"))
    return p.join(q, "page_id").select("page_id", "other_page_id", urls.same_host("url", "other_url").alias("same_host"))


@register("page_info", O.with_fx(f"""SELECT project_id, url, CASE WHEN {PATH_DUCK.format(u='url')}='' THEN '/' ELSE {PATH_DUCK.format(u='url')} END AS path,
   url AS canonical_url, 'STATIC' AS render_mode, true AS is_indexable, '{{}}' AS metadata FROM fx_changes WHERE change_class='new'"""))
def q_page_info(spark, sf_dir):
    from ..operators import catalog
    from .queries import crawl_job
    new = crawl_job(spark, sf_dir).changes.filter(F.col("change_class") == "new").select("project_id", "url")
    out = catalog.fill_defaults(new.withColumn("url", urls.ensure_scheme("url")), "page")
    return out.select("project_id", "url", "path", "canonical_url", "render_mode", "is_indexable", "metadata")


@register("site_root_urls", O.with_fx(f"""SELECT project_id, {ORIGIN_DUCK.format(u='start_url')} || '/robots.txt' AS robots_url,
   {ORIGIN_DUCK.format(u='start_url')} || '/sitemap.xml' AS sitemap_url FROM fx_projects"""))
def q_site_root_urls(spark, sf_dir):
    pr = _fx(spark, sf_dir).projects
    return pr.select("project_id", urls.well_known("start_url", "robots.txt").alias("robots_url"),
                     urls.well_known("start_url", "sitemap.xml").alias("sitemap_url"))


@register("sitemap_docs", O.with_fx(f"""SELECT DISTINCT s.project_id, {ORIGIN_DUCK.format(u='p.start_url')} || '/sitemap.xml' AS url
   FROM fx_sitemap s JOIN fx_projects p ON p.project_id=s.project_id WHERE length(s.project_id)%4 <> 2"""))
def q_sitemap_docs(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return SM.sitemap_docs(fx.sitemap_snapshot, fx.projects).select("project_id", "url")


@register("sitemap_urls", O.with_fx("SELECT project_id, url FROM fx_sitemap WHERE length(project_id)%4 <> 3 OR length(url)%2 = 0"))
def q_sitemap_urls(spark, sf_dir):
    return SM.sitemap_urls(_fx(spark, sf_dir).sitemap_sets)


@register("sitemap_index_expand", O.with_fx("""SELECT DISTINCT project_id, url FROM fx_sitemap WHERE length(project_id)%4 <> 2
   AND (length(project_id)%4 <> 3 OR length(url)%2 = 0)"""))
def q_sitemap_index_expand(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    snapshot = materialize(fx.sitemap_snapshot, "sitemap-snapshot")     # a table at rest, read at every level
    return SM.expand_index(SM.sitemap_docs(snapshot, fx.projects), snapshot)


ROBOTS_RULES_DUCK = ("fx_robot_rules", """SELECT project_id, pos, key, pattern FROM (
   SELECT project_id, pos, key, val AS pattern, last_value(CASE WHEN key='user-agent' THEN val END IGNORE NULLS)
     OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ua
   FROM (SELECT project_id, pos, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, strpos(line, ':') + 1)) AS val
     FROM (SELECT project_id, CAST(i - 1 AS INTEGER) AS pos, trim(line) AS line FROM (
        SELECT project_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (
          SELECT project_id, string_split('# robots for ' || project_id || chr(10) || 'User-agent: otherbot' || chr(10) || 'Disallow: /' || chr(10) || chr(10)
            || 'User-agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /fr/1' || chr(10) || 'Disallow:' || chr(10)
            || '  Allow: /de/2  ' || chr(10) || 'Disallow: /de/' || chr(10) || 'no colon here' || chr(10)
            || 'User-agent: sitewatch-bot' || chr(10) || 'Disallow: /en/9' || chr(10), chr(10)) AS lines
          FROM fx_projects WHERE length(project_id)%3 <> 0)))
       WHERE line<>'' AND NOT starts_with(line, '#') AND strpos(line, ':')>0))
   WHERE key IN ('disallow','allow') AND ua IN ('*','sitewatch-bot')""")


@register("robots_rules", O.with_fx("SELECT * FROM fx_robot_rules", ROBOTS_RULES_DUCK))
def q_robots_rules(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return robots.robots_rules(robots.robots_docs(fx.robots_snapshot, fx.projects), fx.ROBOTS_AGENT)


@register("robots_filter", O.with_fx(f"""SELECT b.page_id, b.project_id, b.path, coalesce((SELECT r.key <> 'disallow' FROM fx_robot_rules r
   WHERE r.project_id=b.project_id AND NOT (r.key='disallow' AND r.pattern='') AND starts_with(b.path, r.pattern) ORDER BY r.pos LIMIT 1), true) AS allowed
   FROM (SELECT page_id, project_id, CASE WHEN {PATH_DUCK.format(u='url')}='' THEN '/' ELSE {PATH_DUCK.format(u='url')} END AS path FROM fx_base) b""",
    ROBOTS_RULES_DUCK))
def q_robots_filter(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rules = robots.robots_rules(robots.robots_docs(fx.robots_snapshot, fx.projects), fx.ROBOTS_AGENT)
    pages = fx.base.select("page_id", "project_id", urls.page_path("url").alias("path"))
    return robots.robots_filter(pages, rules).select("page_id", "project_id", "path", "allowed")


@register("extract_title", O.with_fx(f"SELECT page_id, {O.title('body')} AS title FROM fx_base"))
def q_extract_title(spark, sf_dir):
    return _fx(spark, sf_dir).base.select("page_id", text.title("body").alias("title"))


@register("extract_description", O.with_fx(f"SELECT page_id, {O.description('body')} AS description FROM fx_base"))
def q_extract_description(spark, sf_dir):
    return _fx(spark, sf_dir).base.select("page_id", text.description("body").alias("description"))


@register("visible_text", O.with_fx(f"SELECT page_id, {O.norm('body')} AS visible_text FROM fx_base"))
def q_visible_text(spark, sf_dir):
    return _fx(spark, sf_dir).base.select("page_id", text.visible_text("body").alias("visible_text"))


@register("content_fingerprint", O.with_fx(f"SELECT page_id, sha256({O.norm('body')}) AS content_sha256 FROM fx_base"))
def q_content_fingerprint(spark, sf_dir):
    return _fx(spark, sf_dir).base.select("page_id", text.fingerprint("body").alias("content_sha256"))


# What linked_fetch adds is known by its rule; the other links of these pages are rooted paths
LINK_EDGES_DUCK = ("fx_edges", f"""SELECT DISTINCT project_id, url, link FROM (
   SELECT f.project_id, f.url, c.url AS link FROM fx_ok f JOIN fx_ranked r ON r.project_id=f.project_id AND r.url=f.url
     JOIN fx_ranked c ON c.project_id=r.project_id AND (c.i=0 OR (c.i-1)//2=r.i)
   UNION ALL SELECT project_id, url, {ORIGIN_DUCK.format(u='url')} || unnest(regexp_extract_all(body, '<a href="(/[^"]*)"', 1)) FROM fx_ok)
   WHERE link<>url""")
LINK_CTES = [("fx_ok", "SELECT project_id, url, body FROM fx_fetch WHERE status_code=200"),
             ("fx_ranked", "SELECT project_id, url, row_number() OVER (PARTITION BY project_id ORDER BY url)-1 AS i FROM (SELECT DISTINCT project_id, url FROM fx_base)"),
             LINK_EDGES_DUCK]


@register("link_edges", O.with_fx("SELECT * FROM fx_edges", *LINK_CTES))
def q_link_edges(spark, sf_dir):
    return links.link_edges(_fx(spark, sf_dir).linked_fetch)


# a third of the sites go to any depth (the tree of pages is never 40 deep), the others to 0 to 5 links
@register("depth_limited_frontier", O.with_fx("""WITH fx_walk AS (
   SELECT project_id, start_url AS url, 0 AS depth, CASE WHEN length(project_id)%3=0 THEN 40 ELSE length(project_id)%6 END AS most FROM fx_projects
   UNION SELECT w.project_id, e.link, w.depth+1, w.most FROM fx_walk w JOIN fx_edges e ON e.project_id=w.project_id AND e.url=w.url WHERE w.depth<w.most)
   SELECT project_id, url, min(depth) AS depth FROM fx_walk GROUP BY project_id, url""", *LINK_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def q_depth_limited_frontier(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    size = F.length("project_id")
    sites = fx.projects.withColumn("crawl_depth", F.when(size % 3 != 0, size % 6))
    return links.depth_limited_frontier(links.link_edges(fx.linked_fetch), sites, None)


# --- X1 -----------------------------------------------------------------------------
VALIDATORS_DUCK = [
    ("fx_heads", """SELECT *, CASE page_id%4 WHEN 0 THEN 'W/"v' || page_id || '"' WHEN 1 THEN '"v' || page_id || '"' END AS etag,
      CASE WHEN page_id%3<>0 THEN 'Mon, 01 Jan 2024 00:00:' || lpad(CAST(page_id%60 AS VARCHAR), 2, '0') || ' GMT' END AS last_modified FROM fx_fetch"""),
    ("fx_stored", """SELECT h.project_id, h.url, r.content_sha256, CASE WHEN h.page_id%5=1 THEN '"old"' WHEN h.page_id%4<2 THEN '"v' || h.page_id || '"' END AS etag,
      CASE WHEN h.page_id%5=2 THEN 'Sun, 31 Dec 2023 00:00:00 GMT' ELSE h.last_modified END AS last_modified
      FROM fx_heads h JOIN fx_revisions r ON r.page_id='pg_' || h.page_id"""),
    ("fx_decided", """SELECT h.*, CASE WHEN h.status_code=200 THEN CASE WHEN s.etag IS NOT NULL AND h.etag IS NOT NULL THEN
        CASE WHEN s.etag=replace(h.etag, 'W/', '') THEN 'Not modified: same ETag' END
        WHEN s.last_modified=h.last_modified THEN 'Not modified: same Last-Modified' END END AS reason
      FROM fx_heads h LEFT JOIN fx_stored s ON s.project_id=h.project_id AND s.url=h.url AND coalesce(s.content_sha256, '')<>''""")]


@register("header_prefilter", O.with_fx("SELECT project_id, url, status_code, reason, reason IS NULL AS read FROM fx_decided", *VALIDATORS_DUCK))
def q_header_prefilter(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return validators.header_prefilter(fx.fetch_with_validators, fx.stored_validators)


@register("prefiltered_bodies", O.with_fx("""SELECT DISTINCT d.project_id, d.url, d.status_code, length(d.body) AS body_chars
   FROM fx_heads d JOIN fx_decided x ON x.project_id=d.project_id AND x.url=d.url WHERE x.reason IS NULL""", *VALIDATORS_DUCK))
def q_prefiltered_bodies(spark, sf_dir):
    """The bodies that have to be read, out of a snapshot at rest."""
    import uuid
    from ..session import scratch_table_path
    fx = _fx(spark, sf_dir)
    path = scratch_table_path(spark, f"snapshot-{uuid.uuid4().hex}")
    tables.write_snapshot(fx.fetch_with_validators, path)
    decided = validators.header_prefilter(spark.read.parquet(path), fx.stored_validators)
    rows = validators.bodies_to_read(spark, path, decided)
    return rows.select("project_id", "url", "status_code", F.length("body").alias("body_chars")).distinct()
