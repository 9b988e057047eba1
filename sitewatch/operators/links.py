"""Link graph and the depth-limited frontier.

``link_edges`` takes the links of every fetched page in one pass over the bodies, in
the JVM.  ``depth_limited_frontier`` walks that graph breadth first from each site's
start page: one equi-join a level between the pages found last and the edges, an
anti-join with what is known, until the depth is reached or nothing new is found, so
cycles end.  Bodies are out of the loop, and what a level finds is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..schemas import DEFAULT_MAX_DEPTH
from ..session import materialize
from ..sources.tables import clustered

# an anchor's tag as far as its ">" outside of quotes, and the attributes in it, one after the other
ANCHOR_RE = rf"(?is)<a(?=\s){text.ATTRIBUTES_RE}>"
ATTRIBUTE_RE = r"""(?s)[^\s"'=<>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
HREF_RE = r"""(?is)^href\s*=\s*(?:"([^"]*)"|'([^']*)'|(.+))$"""


def hrefs(html) -> F.Column:
    """The ``href`` of every anchor of a document, in order: the first attribute of that
    name in any letter case, references decoded; anchors in comments and scripts do not count."""
    tags = F.regexp_extract_all(text.strip_blocks(html), F.lit(ANCHOR_RE), 0)

    def href(tag):
        named = F.filter(F.regexp_extract_all(F.substring(tag, 3, 1 << 30), F.lit(ATTRIBUTE_RE), 0), lambda a: a.rlike(HREF_RE))
        first = F.get(named, F.lit(0))
        return F.concat(*[F.regexp_extract(first, HREF_RE, i) for i in (1, 2, 3)])

    return F.filter(F.transform(tags, href), lambda h: h.isNotNull())


def link_edges(snapshot: DataFrame, any_host: bool = False) -> DataFrame:
    """Distinct (project_id, url, link): pages answered with 200 and the pages they link to.

    Links are resolved against the page (P2); of them those on the page's own host (P3)
    count, or all with ``any_host``.  A page's link to itself is none.
    """
    # within arrays: the optimizer copies no expression of one stage into the next
    decoded = F.transform(hrefs("body"), text.decode_entities)
    resolved = F.transform(decoded, lambda h: urls.resolve_link(F.col("url"), h))
    links = (snapshot.filter(F.col("status_code") == 200)
             .select("project_id", "url", F.explode(F.array_distinct(resolved)).alias("link"))
             .filter(F.col("link").isNotNull() & (F.col("link") != F.col("url"))))
    if not any_host:
        links = links.filter(urls.same_host("url", "link"))
    return links.distinct()


def depth_limited_frontier(edges: DataFrame, projects: DataFrame, max_depth: int | None = DEFAULT_MAX_DEPTH) -> DataFrame:
    """(project_id, url, depth) of the pages at most ``max_depth`` links from the start page.

    ``depth`` is the least number of links; ``None`` means any number.  A column
    ``crawl_depth`` of ``projects`` (project_id, start_url) is a limit of each project's
    own, null for none beside ``max_depth``.  ``edges``: (project_id, url, link).  A start
    page counts with its scheme (P1) whether it was fetched or not; so does any page
    that is only linked to.
    """
    own = F.col("crawl_depth") if "crawl_depth" in projects.columns else F.lit(None)
    start = (projects.select("project_id", urls.ensure_scheme("start_url").alias("url"), own.cast("int").alias("limit"))
             .filter(F.col("url").isNotNull() & (F.col("url") != "")).groupBy("project_id", "url").agg(F.max("limit").alias("limit")))
    # laid out by (project, url) once: no level moves the edges again
    edges = clustered(edges.select("project_id", "url", "link"), ["project_id", "url"], "link-edges")
    level = materialize(start.withColumn("depth", F.lit(0)), "frontier")
    known, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        going = level.filter(F.col("limit").isNull() | (F.col("limit") >= depth)).select("project_id", "url", "limit")
        linked = (edges.join(going, ["project_id", "url"]).groupBy("project_id", F.col("link").alias("url"))
                  .agg(F.max("limit").alias("limit"), F.lit(depth).alias("depth")))
        level = materialize(linked.join(known.select("project_id", "url"), ["project_id", "url"], "left_anti"), "frontier")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.select("project_id", "url", "depth")
