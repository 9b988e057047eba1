"""Sitemaps: the document of each site (S2), its URLs (S3) and index
expansion (S4).

XML is parsed with ``from_xml`` in PERMISSIVE mode: a malformed document
yields no URLs and never fails the task (``xpath`` would throw).  Index
expansion parses each document once and then walks the table of their entries
by equi-joins, with an anti-join on visited documents, until none is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import materialize
from .tables import clustered

# --- fixed values ----------------------------------------------------------
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_FILE = "sitemap.xml"
# ---------------------------------------------------------------------------

XML_SCHEMA = "STRUCT<url: ARRAY<STRUCT<loc: STRING>>, sitemap: ARRAY<STRUCT<loc: STRING>>, _malformed: STRING>"
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "ignoreNamespace": "true",
               "ignoreSurroundingSpaces": "false"}
NS_RE = r"xmlns(?::[\w.\-]+)?\s*=\s*[\"']" + SITEMAP_NAMESPACE.replace(".", r"\.") + r"[\"']"


def sitemap_location(start_url) -> "F.Column":
    """``{scheme}://{netloc}/sitemap.xml`` of a start URL (P10)."""
    return urls.well_known(start_url, SITEMAP_FILE)


def sitemap_docs(snapshot: DataFrame, projects: DataFrame) -> DataFrame:
    """Each project's sitemap document; only a 200 response counts."""
    loc = projects.select("project_id", sitemap_location("start_url").alias("url"))
    ok = snapshot.filter(F.col("status_code") == 200).select("project_id", "url", "body")
    return loc.join(ok, ["project_id", "url"])


def parse_entries(docs: DataFrame) -> DataFrame:
    """Entries of sitemap documents: (project_id, doc_url, kind, loc) where kind
    is 'url' for a urlset and 'sitemap' for an index.

    The parsed structure decides: comments, processing instructions and
    prefixes around it do not matter.  Documents that do not parse (among them
    truncated ones) or do not name the sitemap namespace give no entries."""
    parsed = docs.filter(F.col("body").rlike(NS_RE)).select(
        "project_id", F.col("url").alias("doc_url"), F.from_xml(F.col("body"), XML_SCHEMA, XML_OPTIONS).alias("_p"))
    is_index = F.col("_p.url").isNull()
    return (parsed.filter(F.col("_p._malformed").isNull())
            .select("project_id", "doc_url", F.when(is_index, F.lit("sitemap")).otherwise(F.lit("url")).alias("kind"),
                    F.explode(F.coalesce("_p.url", "_p.sitemap")).alias("_e"))
            .select("project_id", "doc_url", "kind", F.col("_e.loc").alias("loc"))
            .filter(F.col("loc").isNotNull()))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """S3: URLs of urlset documents, scheme added when missing."""
    return (parse_entries(docs).filter(F.col("kind") == "url")
            .select("project_id", urls.ensure_scheme("loc").alias("url")))


def entry_table(snapshot: DataFrame) -> DataFrame:
    """Distinct entries of every site map document in ``snapshot``, laid out by document.

    One pass over the bodies: what does not name the sitemap namespace is not parsed.
    """
    ok = snapshot.filter(F.col("status_code") == 200).select("project_id", "url", "body")
    return clustered(parse_entries(ok).distinct(), ["project_id", "doc_url"], "sitemap-entries")


def expand_index(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """URLs of the site maps ``docs`` (project_id, url), following index documents to their
    children (fetched documents in ``snapshot``, status 200) to whatever depth.

    The walk is over the table of entries, (parent, child) rows without bodies: level by
    level the children that the last level's indexes name and no earlier level
    has visited, until none is left, so cycles end too.  Returns distinct
    (project_id, url).
    """
    entries = entry_table(snapshot)
    named = entries.filter(F.col("kind") == "sitemap").select("project_id", "doc_url", F.col("loc").alias("child"))
    level = visited = materialize(docs.select("project_id", F.col("url").alias("doc_url")).distinct(), "sitemap-level")
    while True:
        children = named.join(level, ["project_id", "doc_url"]).select("project_id", F.col("child").alias("doc_url")).distinct()
        level = materialize(children.join(visited, ["project_id", "doc_url"], "left_anti"), "sitemap-level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return (entries.filter(F.col("kind") == "url").join(visited, ["project_id", "doc_url"], "left_semi")
            .select("project_id", urls.ensure_scheme("loc").alias("url")).distinct())


def xml_escape(c) -> "F.Column":
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def urlset_document(locs_col) -> "F.Column":
    """Serialise an array of URLs as a urlset document (used to build test
    snapshots and by writers)."""
    items = F.array_join(F.transform(locs_col, lambda u: F.concat(F.lit("<url><loc>"), xml_escape(u), F.lit("</loc></url>"))), "")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{SITEMAP_NAMESPACE}">'), items,
                    F.lit("</urlset>"))


def index_document(locs_col) -> "F.Column":
    items = F.array_join(F.transform(locs_col, lambda u: F.concat(F.lit("<sitemap><loc>"), xml_escape(u), F.lit("</loc></sitemap>"))), "")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{SITEMAP_NAMESPACE}">'), items,
                    F.lit("</sitemapindex>"))
