"""Relational read model and maintenance: config joins (J4, J5), ownership
(F9, J7), listings (L1), newest artifacts (W3a, W3b) and downloads (J9, P27),
defaults (P28), cascade delete (J12), partial updates (J13), integrity audit
(A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import labels
from .ranking import latest_per_key


def config_with_domain(configs: DataFrame, projects: DataFrame) -> DataFrame:
    """Config inner join project (adds ``domain``).  One row per project on
    both sides, so the join is even; AQE broadcasts a side that is small."""
    p = projects.select(F.col("id").alias("_pid"), "domain")
    return configs.join(p, configs["project_id"] == p["_pid"]).drop("_pid")


def projects_with_config(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """Projects left join their config as a nested struct ``project_configs``."""
    cfg_cols = [c for c in configs.columns if c != "project_id"]
    c = configs.select(F.col("project_id").alias("_pid"), F.struct(*cfg_cols).alias("project_configs"))
    return projects.join(c, projects["id"] == c["_pid"], "left").drop("_pid")


def owner_scope(df: DataFrame, user, owner_col: str = "created_by") -> DataFrame:
    """only rows of the asking user."""
    return df.filter(F.col(owner_col) == F.lit(user))


def owned_runs(runs: DataFrame, projects: DataFrame, user=None) -> DataFrame:
    """Runs of projects the user owns (semi join); without ``user`` every
    run with its owner."""
    if user is not None:
        mine = owner_scope(projects, user).select(F.col("id").alias("project_id"))
        return runs.join(mine, "project_id", "left_semi")
    p = projects.select(F.col("id").alias("project_id"), F.col("created_by").alias("owner"))
    return runs.join(p, "project_id")


def newest_first(df: DataFrame, ts: str = "created_at", key: str = "id") -> DataFrame:
    """L1: ordered by ``created_at`` descending, id breaking ties (range-partitioned sort)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc())


def llms_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter(F.col("type") == S.ARTIFACT_LLMS_TXT)


def latest_artifact_by_run(artifacts: DataFrame) -> DataFrame:
    """Newest LLMS_TXT artifact per run (created_at, then id)."""
    return latest_per_key(llms_artifacts(artifacts), ["run_id"], ["created_at", "id"])


def latest_artifact_by_project(artifacts: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Newest LLMS_TXT artifact per project.  Artifacts without a
    ``project_id`` column get it from their run."""
    arts = llms_artifacts(artifacts)
    if "project_id" not in arts.columns:
        arts = arts.join(runs.select(F.col("id").alias("run_id"), "project_id"), "run_id")
    return latest_per_key(arts, ["project_id"], ["created_at", "id"])


def run_artifact(runs: DataFrame, artifacts: DataFrame, now) -> DataFrame:
    """J9 + P27: per completed run its newest LLMS_TXT artifact and how it is
    delivered (redirect / pointer / body / placeholder; none -> not_found)."""
    ts = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    latest = latest_artifact_by_run(artifacts)
    a_cols = {c: f"a_{c}" for c in latest.columns if c != "run_id"}
    a = latest.select(F.col("run_id").alias("_rid"), *[F.col(c).alias(n) for c, n in a_cols.items()])
    done = runs.filter(F.col("status").isin(*S.COMPLETE_STATUSES))
    j = done.join(a, done["id"] == a["_rid"], "left")
    inline = F.col("a_content") if "a_content" in j.columns else F.lit(None).cast("string")
    kind = F.when(F.col("_rid").isNull(), F.lit("not_found")).otherwise(
        labels.artifact_delivery_kind(F.col("a_public_url"), F.col("a_storage_path"), inline))
    value = (F.when(kind == "redirect", F.col("a_public_url"))
             .when(kind == "pointer", F.col("a_storage_path"))
             .when(kind == "body", inline)
             .when(kind == "placeholder", labels.placeholder_document(F.col("project_id"), F.col("id"),
                                                                      F.col("status"), ts)))
    return j.select(F.col("id").alias("run_id"), "project_id", "status", F.col("a_id").alias("artifact_id"),
                    kind.alias("delivery_kind"), value.alias("delivery_value"))


DEFAULTS = {
    # --- fixed values: defaults of the data model ---------------------------
    "page": {"render_mode": "STATIC", "is_indexable": True, "metadata": "{}"},
    "webhook": {"event_types": ["run.complete"], "is_active": True},
    "project": {"crawl_depth": 2, "cron_expression": "daily", "is_enabled": True, "metadata": "{}"},
    "run_request": {"priority": "NORMAL", "render_mode": "STATIC", "metadata": "{}"},
}


def fill_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Missing (null) fields get the defaults of ``kind``; absent columns
    are added.  A webhook's empty secret becomes null."""
    out = df
    for c, v in DEFAULTS[kind].items():
        lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), lit) if c in df.columns else lit)
    if kind == "page" and "url" in df.columns:
        from ..functions import urls
        if "path" not in df.columns:
            out = out.withColumn("path", urls.page_path("url"))
        out = out.withColumn("canonical_url", F.coalesce(F.col("canonical_url"), F.col("url"))
                             if "canonical_url" in df.columns else F.col("url"))
    if kind == "webhook" and "secret" in df.columns:
        out = out.withColumn("secret", F.when(F.col("secret") != "", F.col("secret")))
    return out


# Tables that reference projects and how (cascade or set null).
CASCADE = {
    "project_configs": ("project_id", "cascade"),
    "webhooks": ("project_id", "cascade"),
    "runs": ("project_id", "cascade"),
    "pages": ("project_id", "cascade"),
    "artifacts": ("project_id", "cascade"),
}


# References that become null when what they name is deleted.
SET_NULL = (("webhook_events", "webhook_id", "webhooks"), ("artifacts", "run_id", "runs"),
            ("page_revisions", "run_id", "runs"), ("pages", "current_revision_id", "page_revisions"))


def cascade_delete(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove projects everywhere.

    ``project_ids`` has one column ``id``.  Configs, webhooks, runs, pages and
    artifacts go with their project, page revisions with their page.  What
    stays loses its reference to what went: events to webhooks, artifacts and
    revisions to runs, pages to revisions.
    """
    gone = project_ids.select(F.col("id").alias("project_id")).distinct()
    out = dict(tables)
    if "projects" in tables:
        out["projects"] = tables["projects"].join(gone.withColumnRenamed("project_id", "id"), "id", "left_anti")
    for name, (col, _) in CASCADE.items():
        if name in tables and col in tables[name].columns:
            out[name] = tables[name].join(gone, col, "left_anti")
    if "page_revisions" in tables and "pages" in tables:
        dead_pages = tables["pages"].join(gone, "project_id", "left_semi").select(F.col("id").alias("page_id"))
        out["page_revisions"] = tables["page_revisions"].join(dead_pages, "page_id", "left_anti")
    for child, col, parent in SET_NULL:
        if child in out and parent in out and col in out[child].columns:
            if parent == "page_revisions":
                dead = tables[parent].join(dead_pages, "page_id", "left_semi")
            else:
                dead = tables[parent].join(gone, "project_id", "left_semi")
            out[child] = _without_reference(out[child], col, dead.select("id"))
    return out


def _without_reference(df: DataFrame, col: str, dead: DataFrame) -> DataFrame:
    """``df`` with ``col`` null where it names one of the ids of ``dead``."""
    mark = dead.select(F.col("id").alias("_dead")).distinct()
    j = df.join(mark, df[col] == mark["_dead"], "left")
    return j.select(*[F.when(F.col("_dead").isNull(), F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])


def apply_patches(df: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Partial update.  ``patches`` has the key, and per field ``x`` a flag
    ``has_x`` and the value ``x``; only provided fields change, and an explicit
    null is a change.  Several patches of one row: the one with the greatest
    ``seq`` wins."""
    fields = [c[4:] for c in patches.columns if c.startswith("has_") and c[4:] in df.columns]
    p = patches
    if "seq" in p.columns:
        p = latest_per_key(p, [key], ["seq"])
    p = p.select(F.col(key).alias("_k"), *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields],
                 *[F.col(f).alias(f"_new_{f}") for f in fields])
    j = df.join(p, df[key] == p["_k"], "left")
    return j.select(*[
        F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_new_{c}").cast(df.schema[c].dataType))
         .otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def integrity_audit(tables: dict[str, DataFrame], skip: tuple[str, ...] = ()) -> DataFrame:
    """Violations of uniqueness, foreign keys, enums and not-null, one row
    per (check, table) with the number of offending rows."""
    findings = []

    def add(check: str, table: str, df: DataFrame):
        findings.append(df.agg(F.count(F.lit(1)).alias("n_violations"))
                        .select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), "n_violations"))

    t = tables
    if "pages" in t:
        dup = t["pages"].groupBy("project_id", "url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        add("unique_project_url", "pages", dup)
    fks = [("project_configs", "project_id", "projects", "id"), ("webhooks", "project_id", "projects", "id"),
           ("runs", "project_id", "projects", "id"), ("pages", "project_id", "projects", "id"),
           ("page_revisions", "page_id", "pages", "id"), ("webhook_events", "webhook_id", "webhooks", "id"),
           ("artifacts", "run_id", "runs", "id"), ("artifacts", "project_id", "projects", "id"),
           ("page_revisions", "run_id", "runs", "id"), ("pages", "current_revision_id", "page_revisions", "id")]
    for child, col, parent, pcol in fks:
        if f"{child}.{col}" in skip:
            continue
        if child in t and parent in t and col in t[child].columns:
            ref = t[parent].select(F.col(pcol).alias(col)).distinct()
            orphans = t[child].filter(F.col(col).isNotNull()).join(ref, col, "left_anti")
            add(f"fk_{col}", child, orphans)
    enums = [("runs", "status", S.KNOWN_RUN_STATUSES), ("pages", "render_mode", S.RENDER_MODES),
             ("artifacts", "type", S.ARTIFACT_TYPES)]
    not_null = [("projects", "name"), ("projects", "domain"), ("pages", "url"), ("webhooks", "url"),
                ("runs", "status")]
    # what a row shows by itself: one pass over each table
    for table in t:
        own = [(f"enum_{c}", F.col(c).isNull() | ~F.col(c).isin(*allowed)) for n, c, allowed in enums if n == table and c in t[table].columns]
        own += [(f"not_null_{c}", F.col(c).isNull()) for n, c in not_null if n == table and c in t[table].columns]
        if own:
            counted = t[table].agg(*[F.count_if(bad).alias(check) for check, bad in own])
            findings.append(counted.select(F.explode(F.array(*[
                F.struct(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.col(check).alias("n_violations"))
                for check, _ in own])).alias("f")).select("f.*"))
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def validate_projects(df: DataFrame) -> DataFrame:
    """Project create/update check.  ``domain`` gets https:// unless it
    starts with 'http'; name and domain are required; the normalised URL must
    parse with a host.  Adds domain_input, domain (normalised), is_valid,
    reject_reason and form_ok (the stricter client-side regex)."""
    from ..functions import urls
    norm = urls.normalize_domain(F.col("domain"))
    required = (F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("domain"), F.lit("")) != "")
    valid = urls.is_valid_url(norm)
    return (df.withColumn("domain_input", F.col("domain")).withColumn("domain", norm)
            .withColumn("is_valid", required & valid)
            .withColumn("reject_reason", F.when(~required, F.lit("Name and domain are required"))
                        .when(~valid, F.lit("Invalid domain URL")))
            .withColumn("form_ok", urls.form_url_ok(F.col("domain"))))
