"""Site index document (A4) with its parts: start page (W2), header (P12),
lines (P11), size (P13), location (P14), artifact rows (S8) and the document
sink (S7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..schemas import ARTIFACT_BUCKET, ARTIFACT_LLMS_TXT, ARTIFACT_PREFIX, ARTIFACT_SUFFIX
from ..sources.documents import write_objects

# --- fixed values: document layout -----------------------------------------
DEFAULT_NAME = "Website"
DEFAULT_DESCRIPTION_PREFIX = "Website content from "
PAGES_HEADING = "## Pages"
# ---------------------------------------------------------------------------


def _nz(c: Column) -> Column:
    """null when empty."""
    return F.when(c == "", F.lit(None)).otherwise(c)


def index_line(url, title, desc) -> Column:
    """``- [title or url](url)`` plus ``: description`` when not empty."""
    u = F.col(url) if isinstance(url, str) else url
    t = text.py_strip(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))
    d = text.py_strip(F.coalesce(F.col(desc) if isinstance(desc, str) else desc, F.lit("")))
    link = F.concat(F.lit("- ["), F.when(t != "", t).otherwise(u), F.lit("]("), u, F.lit(")"))
    return F.when(d != "", F.concat(link, F.lit(": "), d)).otherwise(link)


def index_header(start_url: Column, sp_title: Column, sp_desc: Column) -> Column:
    """``# name`` and ``> description`` lines plus the pages heading.

    name: start page title, else netloc of the start URL, else the start URL,
    else "Website".  description: start page description, else
    "Website content from {start_url}".  A missing start page gives null
    ``sp_*`` and the same fallbacks.
    """
    su = F.coalesce(start_url, F.lit(""))
    name = F.coalesce(_nz(text.py_strip(sp_title)), _nz(urls.netloc(su)), _nz(su), F.lit(DEFAULT_NAME))
    desc = F.coalesce(_nz(text.py_strip(sp_desc)), F.concat(F.lit(DEFAULT_DESCRIPTION_PREFIX), su))
    return F.concat(F.lit("# "), name, F.lit("\n\n> "), desc, F.lit("\n\n" + PAGES_HEADING + "\n"))


def start_page(crawled: DataFrame) -> DataFrame:
    """Per project the crawled page whose URL is the start URL, else the first
    crawled page (``crawled`` carries ``is_start`` and ``crawl_rank``)."""
    return crawled.groupBy("project_id").agg(
        F.min(F.struct((~F.col("is_start")).alias("not_start"), F.col("crawl_rank"),
                       F.col("url"), F.col("title"), F.col("description"))).alias("sp"))


def site_index(budget: DataFrame, projects: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """A4 (flagship): one markdown document per project that has changes.

    ``budget``: the budgeted pages (W1) with url, title, description,
    is_start, crawl_rank, fetched, status_code.  Only fetched-OK pages become
    lines (F3); pages without URL are left out of the list but still count as
    start-page candidates; no trailing newline.

    Everything per project comes from ONE aggregate over the budget, which
    Spark runs on the window's own hash partitioning (no extra shuffle); the
    group size is bounded by the budget, so ``collect_list`` is safe.  A
    project has changes exactly when its budget is not empty (for a budget of
    at least one page); with ``summary`` (A1) the flag comes from there.
    """
    ok = F.coalesce(F.col("fetched"), F.lit(True)) & (F.coalesce(F.col("status_code"), F.lit(200)) == 200)
    line = F.when(ok & (F.coalesce(F.col("url"), F.lit("")) != ""),
                  F.struct(F.col("crawl_rank"), index_line("url", "title", "description").alias("line")))
    per_project = budget.groupBy("project_id").agg(
        F.min(F.when(ok, F.struct((~F.col("is_start")).alias("not_start"), F.col("crawl_rank"),
                                  F.col("title"), F.col("description")))).alias("sp"),
        F.array_sort(F.collect_list(line)).alias("_lines"))
    if summary is not None:
        per_project = (summary.filter(F.col("has_changes")).select("project_id")
                       .join(per_project, "project_id", "left"))
    body = F.array_join(F.transform(F.coalesce(F.col("_lines"), F.array()), lambda z: z["line"]), "\n")
    doc = F.concat(index_header(F.col("start_url"), F.col("sp.title"), F.col("sp.description")),
                   F.when(F.coalesce(F.size(F.col("_lines")), F.lit(0)) > 0, F.concat(F.lit("\n"), body))
                    .otherwise(F.lit("")))
    return (per_project.join(projects.select("project_id", "start_url"), "project_id")
            .select("project_id", doc.alias("document")))


def utf8_size(col) -> Column:
    """Byte length of a document."""
    return F.octet_length(F.col(col) if isinstance(col, str) else col)


def artifact_file_name(job_id: Column) -> Column:
    """``llms_{job}.txt``."""
    return F.concat(F.lit(ARTIFACT_PREFIX), job_id, F.lit(ARTIFACT_SUFFIX))


def artifact_location(job_id: Column, public_base: str, store: str = f"s3://{ARTIFACT_BUCKET}") -> tuple[Column, Column, Column]:
    """File name, storage path ``s3://{bucket}/{file}`` (or in another ``store``) and public URL."""
    name = artifact_file_name(job_id)
    return (name, F.concat(F.lit(store.rstrip("/") + "/"), name),
            F.concat(F.lit(public_base.rstrip("/") + f"/{ARTIFACT_BUCKET}/"), name))


def artifact_rows(docs: DataFrame, now, public_base: str, store: str = f"s3://{ARTIFACT_BUCKET}") -> DataFrame:
    """One artifact row per written document (``docs`` has project_id,
    run_id, job_id, document); ``storage_path`` is the object S7 writes into ``store``."""
    name, path, public = artifact_location(F.col("job_id"), public_base, store)
    ts = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    from ..functions.labels import iso_utc
    meta = F.to_json(F.struct(public.alias("public_url"), F.lit(ARTIFACT_BUCKET).alias("bucket"),
                              name.alias("key"), iso_utc(ts).alias("uploaded_at")))
    return docs.select(
        F.concat(F.lit("art_"), F.col("run_id")).alias("id"), "project_id", "run_id",
        F.lit(ARTIFACT_LLMS_TXT).alias("type"), path.alias("storage_path"), name.alias("file_name"),
        utf8_size("document").cast("bigint").alias("size_bytes"), F.lit(0).alias("downloaded_count"),
        ts.alias("created_at"), meta.alias("metadata"), public.alias("public_url"))


def write_documents(docs: DataFrame, store: str) -> None:
    """Write each document (``docs`` has job_id and document) as the one object that
    its artifact row names: ``{store}/llms_{job}.txt``."""
    write_objects(docs.select(artifact_file_name(F.col("job_id")).alias("file_name"), "document"), store)
