"""Registered queries of the crawl side: S1 S6 U1 J1 J2 J3 A1 U2 W1 F3 A2 A3
J10 W2 P11 P12 A4 P13 P14 S8 S9 S10 W7 P5-P9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes as ch
from ..operators import crawl, index
from ..session import materialize
from . import oracle as O
from .queries import BUDGET_TEST_MAX_PAGES, SITE_INDEX_MAX_PAGES, crawl_job, register

CHANGE_COLS = ["project_id", "url", "page_id", "change_class", "change_reason", "old_revision_id"]


@register("frontier_union", O.with_fx("SELECT project_id, url FROM fx_frontier"))
def q_frontier_union(spark, sf_dir):
    return crawl_job(spark, sf_dir).frontier


@register("frontier_vs_catalogue", O.with_fx(
    "SELECT f.project_id, f.url, p.id AS page_id, p.id IS NOT NULL AS is_known FROM fx_frontier f "
    "LEFT JOIN fx_pages p ON p.project_id=f.project_id AND p.url=f.url"))
def q_frontier_vs_catalogue(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    return ch.match_frontier(job.frontier, job.inputs.pages)


@register("pages_with_revision", O.with_fx(
    "SELECT p.id, p.project_id, p.url, p.current_revision_id, r.id AS current_revision_id_found, "
    "r.content_sha256 AS current_revision_sha256 FROM fx_pages p LEFT JOIN fx_revisions r ON r.id=p.current_revision_id"))
def q_pages_with_revision(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    return ch.with_current_revision(job.inputs.pages, job.inputs.revisions).select(
        "id", "project_id", "url", "current_revision_id",
        F.col("current_revision.id").alias("current_revision_id_found"),
        F.col("current_revision.content_sha256").alias("current_revision_sha256"))


@register("change_classify", O.with_fx(
    "SELECT project_id, url, page_id, change_class, change_reason, old_revision_id FROM fx_changes"))
def q_change_classify(spark, sf_dir):
    return crawl_job(spark, sf_dir).changes.select(*CHANGE_COLS)


@register("change_classify_laid_out", O.with_fx(
    "SELECT project_id, url, page_id, change_class, change_reason, old_revision_id FROM fx_changes"))
def q_change_classify_laid_out(spark, sf_dir):
    """J1 and J3 over tables bucketed by (project, URL)."""
    return crawl_job(spark, sf_dir).laid_out().changes.select(*CHANGE_COLS)


@register("change_summary", O.with_fx("SELECT * FROM fx_summary"))
def q_change_summary(spark, sf_dir):
    return crawl_job(spark, sf_dir).summary


@register("crawl_candidates", O.with_fx(
    "SELECT project_id, url, change_class, CASE change_class WHEN 'changed' THEN 0 ELSE 1 END AS class_order "
    "FROM fx_changes WHERE change_class IN ('changed','new')"))
def q_crawl_candidates(spark, sf_dir):
    return ch.crawl_candidates(crawl_job(spark, sf_dir).changes).select(
        "project_id", "url", "change_class", "class_order")


@register("crawl_budget", O.with_fx(
    "SELECT project_id, url, change_class, is_start, rk AS crawl_rank FROM fx_budget",
    O.budget_cte(BUDGET_TEST_MAX_PAGES)))
def q_crawl_budget(spark, sf_dir):
    job = crawl_job(spark, sf_dir, BUDGET_TEST_MAX_PAGES)
    return job.budget.select("project_id", "url", "change_class", "is_start", "crawl_rank")


@register("http_ok", O.with_fx(
    "SELECT project_id, url, crawl_rank FROM (SELECT project_id, url, rk AS crawl_rank, fetched, status_code FROM fx_budget) "
    "WHERE fetched AND status_code=200", O.budget_cte(SITE_INDEX_MAX_PAGES)))
def q_http_ok(spark, sf_dir):
    return crawl_job(spark, sf_dir).crawled.select("project_id", "url", "crawl_rank")


def site_index_ctes(max_pages: int) -> list[tuple[str, str]]:
    """DuckDB CTEs ending in ``fx_documents(project_id, document)``."""
    line = ("concat('- [', CASE WHEN " + O.py_strip("coalesce(title,'')") + "<>'' THEN " + O.py_strip("title")
            + " ELSE url END, '](', url, ')', CASE WHEN " + O.py_strip("coalesce(description,'')")
            + "<>'' THEN ': ' || " + O.py_strip("description") + " ELSE '' END)")
    crawled = ("fx_crawled", "SELECT * FROM fx_budget WHERE fetched AND status_code=200")
    per = ("fx_doc_parts", f"""SELECT project_id,
        arg_min(title, (NOT is_start, rk)) AS sp_title, arg_min(description, (NOT is_start, rk)) AS sp_desc,
        string_agg(CASE WHEN coalesce(url,'')<>'' THEN {line} END, chr(10) ORDER BY rk) AS body,
        count(CASE WHEN coalesce(url,'')<>'' THEN 1 END) AS n_lines
        FROM fx_crawled GROUP BY project_id""")
    netloc = "regexp_extract(s.start_url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://([^/?#]*))?', 1)"
    name = (f"coalesce(nullif({O.py_strip('d.sp_title')},''), nullif({netloc},''), nullif(s.start_url,''), 'Website')")
    desc = f"coalesce(nullif({O.py_strip('d.sp_desc')},''), 'Website content from ' || coalesce(s.start_url,''))"
    docs = ("fx_documents", f"""SELECT m.project_id, concat('# ', {name}, chr(10), chr(10), '> ', {desc}, chr(10), chr(10), '## Pages', chr(10),
        CASE WHEN coalesce(d.n_lines,0)>0 THEN chr(10) || d.body ELSE '' END) AS document
        FROM fx_summary m JOIN fx_projects s ON s.project_id=m.project_id LEFT JOIN fx_doc_parts d ON d.project_id=m.project_id
        WHERE m.has_changes""")
    return [O.budget_cte(max_pages), crawled, per, docs]


def _site_index_sql(max_pages: int) -> str:
    return O.with_fx("SELECT project_id, document FROM fx_documents", *site_index_ctes(max_pages))


@register("site_index", _site_index_sql(SITE_INDEX_MAX_PAGES))
def q_site_index(spark, sf_dir):
    return crawl_job(spark, sf_dir).documents


@register("site_index_small_budget", _site_index_sql(BUDGET_TEST_MAX_PAGES))
def q_site_index_small_budget(spark, sf_dir):
    return crawl_job(spark, sf_dir, BUDGET_TEST_MAX_PAGES).documents


# --- crawl results, revisions, page upsert, artifacts -------------------------------------------
from .queries import FIXED_NOW, FIXED_NOW_ISO, PUBLIC_BASE  # noqa: E402

NOW_SQL = f"TIMESTAMP '{FIXED_NOW}'"
CRAWLED = ("fx_crawled", "SELECT * FROM fx_budget WHERE fetched AND status_code=200")
DEDUP = ("fx_dedup", """SELECT project_id, url, page_id IS NULL AS is_new_page, pid AS page_id, change_reason, title, description, content_sha256,
   'run_' || project_id AS run_id, NOT same AS is_new_revision,
   CASE WHEN same THEN old_revision_id ELSE 'rev_' || sha256(pid || '|' || 'run_' || project_id) END AS revision_id, rk
   FROM (SELECT *, coalesce(page_id, 'pg_' || sha256(project_id || '|' || url)) AS pid,
     coalesce(old_revision_id IS NOT NULL AND old_content_sha256 IS NOT NULL AND old_content_sha256 = content_sha256, false) AS same
     FROM fx_crawled)""")


@register("pages_crawled", O.with_fx("SELECT project_id, count(*) AS pages_crawled FROM fx_crawled GROUP BY project_id",
                                     O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED))
def q_pages_crawled(spark, sf_dir):
    return crawl_job(spark, sf_dir).crawled.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages_crawled"))


@register("crawl_result", O.with_fx(f"""SELECT m.project_id, s.start_url,
   CASE WHEN m.has_changes THEN coalesce(c.n, 0) ELSE 0 END AS pages_crawled, {SITE_INDEX_MAX_PAGES} AS max_pages, 2 AS max_depth,
   m.has_changes AS changes_detected, m.n_changed, m.n_new, m.n_unchanged,
   CASE WHEN m.has_changes THEN coalesce(c.urls, '') ELSE '' END AS page_urls
   FROM fx_summary m JOIN fx_projects s ON s.project_id=m.project_id
   LEFT JOIN (SELECT project_id, count(*) AS n, string_agg(url, ' ' ORDER BY rk) AS urls FROM fx_crawled GROUP BY project_id) c ON c.project_id=m.project_id""",
    O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED))
def q_crawl_result(spark, sf_dir):
    r = crawl_job(spark, sf_dir).cut_changes().crawl_results
    return r.select("project_id", "start_url", "pages_crawled", "max_pages", "max_depth", "changes_detected",
                    "n_changed", "n_new", "n_unchanged",
                    F.array_join(F.transform("pages", lambda p: p["url"]), " ").alias("page_urls"))


@register("revision_dedup", O.with_fx("SELECT project_id, url, page_id, is_new_page, revision_id, is_new_revision FROM fx_dedup",
                                      O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED, DEDUP))
def q_revision_dedup(spark, sf_dir):
    return crawl_job(spark, sf_dir).crawled_with_ids.select(
        "project_id", "url", "page_id", "is_new_page", "revision_id", "is_new_revision")


@register("revision_append", O.with_fx(f"""SELECT d.revision_id AS id, d.page_id, d.run_id, length(f.content) AS content_chars, d.content_sha256,
   d.title, d.description AS meta_description, {NOW_SQL} AS created_at,
   json_object('change_reason', coalesce(d.change_reason, 'Unknown'))::VARCHAR AS metadata
   FROM fx_dedup d JOIN (SELECT project_id, url, sha256({O.norm("body")}) AS h, min(body) AS content FROM fx_fetch WHERE status_code=200 GROUP BY ALL) f
     ON f.project_id=d.project_id AND f.url=d.url AND f.h=d.content_sha256 WHERE d.is_new_revision""",
    O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED, DEDUP))
def q_revision_append(spark, sf_dir):
    revs = crawl_job(spark, sf_dir).new_revisions(FIXED_NOW)
    return revs.withColumn("content_chars", F.length("content")).drop("content")


@register("page_upsert", O.with_fx(f"""SELECT p.id, p.project_id, p.url,
   CASE WHEN d.page_id IS NOT NULL AND d.is_new_revision THEN d.revision_id ELSE p.current_revision_id END AS current_revision_id,
   CASE WHEN d.page_id IS NOT NULL THEN {NOW_SQL} END AS last_seen_at
   FROM fx_pages p LEFT JOIN (SELECT * FROM fx_dedup WHERE NOT is_new_page) d ON d.page_id=p.id
   UNION ALL SELECT page_id, project_id, url, revision_id, {NOW_SQL} FROM fx_dedup WHERE is_new_page""",
    O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED, DEDUP))
def q_page_upsert(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    pages = job.inputs.pages.withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    return crawl.upsert_pages(pages, job.crawled_with_ids, FIXED_NOW)


@register("current_revision", O.with_fx("""SELECT page_id, arg_max(id, (created_at, id)) AS current_revision_id FROM (
   SELECT id, page_id, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM fx_revisions
   UNION ALL SELECT revision_id, page_id, TIMESTAMP '2024-03-15 12:00:00' FROM fx_dedup WHERE is_new_revision) GROUP BY page_id""",
    O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED, DEDUP))
def q_current_revision(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    old = job.inputs.revisions.select("id", "page_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    new = job.new_revisions(FIXED_NOW).select("id", "page_id", "created_at")
    return crawl.current_revision(old.unionByName(new))


@register("start_page", O.with_fx("""SELECT project_id, arg_min(url, (NOT is_start, rk)) AS url, arg_min(title, (NOT is_start, rk)) AS title
   FROM fx_crawled GROUP BY project_id""", O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED))
def q_start_page(spark, sf_dir):
    sp = index.start_page(crawl_job(spark, sf_dir).crawled)
    return sp.select("project_id", F.col("sp.url").alias("url"), F.col("sp.title").alias("title"))


def _line_sql() -> str:
    return ("concat('- [', CASE WHEN " + O.py_strip("coalesce(title,'')") + "<>'' THEN " + O.py_strip("title")
            + " ELSE url END, '](', url, ')', CASE WHEN " + O.py_strip("coalesce(description,'')")
            + "<>'' THEN ': ' || " + O.py_strip("description") + " ELSE '' END)")


@register("index_line", O.with_fx(f"SELECT project_id, url, rk AS crawl_rank, {_line_sql()} AS line FROM fx_crawled",
                                  O.budget_cte(SITE_INDEX_MAX_PAGES), CRAWLED))
def q_index_line(spark, sf_dir):
    c = crawl_job(spark, sf_dir).crawled
    return c.select("project_id", "url", "crawl_rank", index.index_line("url", "title", "description").alias("line"))


@register("index_header", O.with_fx("SELECT project_id, split_part(document, chr(10) || '## Pages', 1) || chr(10) || '## Pages' || chr(10) AS header FROM fx_documents",
                                    *site_index_ctes(SITE_INDEX_MAX_PAGES)))
def q_index_header(spark, sf_dir):
    job = crawl_job(spark, sf_dir)
    sp = index.start_page(job.crawled)
    flagged = job.summary.filter("has_changes").select("project_id")
    j = flagged.join(job.projects, "project_id").join(sp, "project_id", "left")
    return j.select("project_id", index.index_header(F.col("start_url"), F.col("sp.title"), F.col("sp.description")).alias("header"))


@register("change_reason", O.with_fx("SELECT project_id, url, change_reason FROM fx_changes WHERE change_class='changed'"))
def q_change_reason(spark, sf_dir):
    ch_ = crawl_job(spark, sf_dir).changes
    return ch_.filter(F.col("change_class") == "changed").select("project_id", "url", "change_reason")


@register("artifact_records", O.with_fx(f"""SELECT 'art_run_' || project_id AS id, project_id, 'run_' || project_id AS run_id, 'LLMS_TXT' AS type,
   's3://llms-txt/llms_job_' || project_id || '.txt' AS storage_path, 'llms_job_' || project_id || '.txt' AS file_name,
   CAST(strlen(document) AS BIGINT) AS size_bytes, 0 AS downloaded_count, {NOW_SQL} AS created_at,
   json_object('public_url', '{PUBLIC_BASE}/llms-txt/llms_job_' || project_id || '.txt', 'bucket', 'llms-txt', 'key', 'llms_job_' || project_id || '.txt',
     'uploaded_at', '{FIXED_NOW_ISO}')::VARCHAR AS metadata, '{PUBLIC_BASE}/llms-txt/llms_job_' || project_id || '.txt' AS public_url
   FROM fx_documents""", *site_index_ctes(SITE_INDEX_MAX_PAGES)))
def q_artifact_records(spark, sf_dir):
    return crawl_job(spark, sf_dir).artifacts(FIXED_NOW, PUBLIC_BASE)


@register("artifact_sink", O.with_fx("SELECT 'llms_job_' || project_id || '.txt' AS file_name, document FROM fx_documents",
                                     *site_index_ctes(SITE_INDEX_MAX_PAGES)))
def q_artifact_sink(spark, sf_dir):
    """S7 round trip: every document becomes an object in a store under the shared scratch
    folder, and is read from the place that its artifact row (S8) names."""
    import uuid
    from ..session import scratch_table_path
    from ..sources.documents import read_objects
    store = scratch_table_path(spark, f"documents-{uuid.uuid4().hex}")
    docs = materialize(crawl_job(spark, sf_dir).run_documents, "run-documents")
    index.write_documents(docs, store)
    rows = index.artifact_rows(docs, FIXED_NOW, PUBLIC_BASE, store)
    objects = read_objects(spark, store).withColumn("storage_path", F.concat(F.lit(store + "/"), "file_name"))
    return objects.join(rows.select("storage_path", "size_bytes"), "storage_path").filter(
        F.octet_length("document") == F.col("size_bytes")).select("file_name", "document")
