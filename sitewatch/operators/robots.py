"""robots.txt as tables: rules (F1) and the allow/deny decision (F2).

Semantics kept from the reference: lines are stripped, blank and ``#`` lines
skipped, a line splits at its first ':'; a rule belongs to the most recent
User-agent line; groups ``*`` and our exact agent are merged in file order;
the first rule whose pattern is a prefix of the path decides (an empty
Disallow is skipped, an empty Allow matches everything); no rule or no
robots file means allowed.  Matching is case-sensitive and has no wildcards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

# --- fixed values ----------------------------------------------------------
ROBOTS_FILE = "robots.txt"
# ---------------------------------------------------------------------------


def robots_docs(snapshot: DataFrame, projects: DataFrame) -> DataFrame:
    """robots.txt of each project from the snapshot (status 200 only)."""
    loc = projects.select("project_id", urls.well_known("start_url", ROBOTS_FILE).alias("url"))
    ok = snapshot.filter(F.col("status_code") == 200).select("project_id", "url", "body")
    return loc.join(ok, ["project_id", "url"]).select("project_id", "body")


def robots_rules(docs: DataFrame, agent: str) -> DataFrame:
    """ordered rules (project_id, pos, key, pattern) that apply to ``agent``.

    The carry-forward of the User-agent is a window over one robots file
    (bounded by the file size), not over a site's pages.
    """
    lines = (docs.select("project_id", F.posexplode(F.split(F.col("body"), r"\r\n|\n|\r")).alias("pos", "raw"))
             .withColumn("line", text.py_strip(F.col("raw")))
             .filter((F.col("line") != "") & ~F.col("line").startswith("#") & (F.instr("line", ":") > 0)))
    kv = lines.select(
        "project_id", "pos",
        F.lower(text.py_strip(F.substring_index("line", ":", 1))).alias("key"),
        text.py_strip(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    w = Window.partitionBy("project_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_ua = kv.withColumn("ua", F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(w))
    return (with_ua.filter(F.col("key").isin("disallow", "allow") & F.col("ua").isin("*", agent))
            .select("project_id", "pos", "key", F.col("value").alias("pattern")))


def robots_filter(pages: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """add ``allowed`` to pages (project_id, path, ...).

    Rules are folded into one ordered array per project (bounded by the robots
    file) and joined to the pages; AQE broadcasts that side when it is small
    and splits a huge site's partition otherwise.
    """
    per_project = rules.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "pattern"))).alias("_rules"))
    j = pages.join(per_project, "project_id", "left")
    path = F.col(path_col)
    first = F.get(F.filter(F.coalesce(F.col("_rules"), F.array().cast("array<struct<pos:int,key:string,pattern:string>>")),
                           lambda r: ~((r["key"] == "disallow") & (r["pattern"] == "")) & path.startswith(r["pattern"])), 0)
    return j.withColumn("allowed", F.coalesce(first["key"] != "disallow", F.lit(True))).drop("_rules")
