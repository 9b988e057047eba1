"""DuckDB SQL twins of the registered queries (the correctness oracle).

The ``fx_*`` views are inlined as CTEs over the driver's tables; the text
recipe is written in RE2 syntax (no look-ahead, no back-references).
"""

from __future__ import annotations

import re

ATTRIBUTES = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""      # quotes doubled: stands inside SQL strings
BLOCKS = r"<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?:\s{ATTRIBUTES})?>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "iframe"))


def strip_blocks(x: str) -> str:
    return f"regexp_replace({x},'{BLOCKS}','','gis')"


def decode(x: str) -> str:
    for pat, rep in (("&eacute;", "é"), ("&#8217;", "’"), ("&nbsp;", "\u00a0"), ("&notit;", "¬it;"), ("&ltimes;", "⋉"), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"),
                     ("&quot;?", '"'), ("&amp;?", "&")):
        x = f"regexp_replace({x},'{pat}','{rep}','g')"
    return x


def norm_from_stripped(x: str) -> str:
    return "trim(regexp_replace(" + decode(f"regexp_replace({x},'<[A-Za-z/!?]{ATTRIBUTES}>','','gs')") + r",'[\s\x{00a0}]+',' ','g'))"


def norm(x: str) -> str:
    return norm_from_stripped(strip_blocks(x))


def py_strip(x: str) -> str:
    return rf"regexp_replace({x},'^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$','','g')"


def title(x: str) -> str:
    return py_strip(decode(f"regexp_extract({strip_blocks(x)},'<title\\b[^>]*>(.*?)</title\\s*>',1,'is')"))


def description(x: str) -> str:
    return py_strip(decode(f"""regexp_extract({strip_blocks(x)},'<meta name="description" content="([^"]*)">',1)"""))


CTES = {
    "fx_base": ([], """SELECT page_id, regexp_extract(url,'^https?://([^/:?#]+)',1) AS project_id, regexp_replace(url,'#.*$','') AS url,
   CASE WHEN page_id%23=0 THEN 404 WHEN page_id%29=0 THEN 500 ELSE 200 END AS status_code,
   replace(replace(replace(CASE WHEN page_id%10=0 THEN regexp_replace(html,'<title>.*?</title>','<title></title>','s') ELSE html END,
     '</title>', CASE WHEN page_id%3<>0 THEN concat('</title><meta data-name="description" content="decoy"><meta name="description" content=" Page ',CAST(page_id AS STRING),' summary ">') ELSE '</title>' END),
     '</body>', CASE WHEN page_id%4=0 THEN '<noscript>ns</noscript><iframe src="x">if</iframe></body>' ELSE '</body>' END),
     '</body>', CASE WHEN page_id%6=1 THEN '<p data-x="a>b">caf&eacute; &#8217; R&D 5 < 6&nbsp;x &notit; &ltimes;</p></body>'
       WHEN page_id%6=4 THEN '<script>var t = "leak";</body>' ELSE '</body>' END) AS body FROM pages"""),
    "fx_fetch": (["fx_base"], "SELECT page_id, project_id, url, status_code, body FROM fx_base WHERE page_id%31<>0"),
    "fx_pages": (["fx_base"], "SELECT concat('pg_',CAST(page_id AS STRING)) AS id, project_id, url, CASE WHEN page_id%7=0 THEN NULL ELSE concat('rev_',CAST(page_id AS STRING)) END AS current_revision_id FROM fx_base WHERE page_id%5<>0"),
    "fx_revisions": (["fx_base"], "SELECT concat('rev_',CAST(page_id AS STRING)) AS id, concat('pg_',CAST(page_id AS STRING)) AS page_id, CASE WHEN page_id%11=0 THEN NULL WHEN page_id%13=0 THEN '' WHEN page_id%3=0 THEN sha256('old') ELSE sha256(" + norm("body") + ") END AS content_sha256 FROM fx_base WHERE page_id%5<>0 AND page_id%7<>0 AND page_id%17<>0"),
    "fx_sitemap": (["fx_base"], "SELECT project_id, url FROM fx_base WHERE page_id%2=0"),
    "fx_projects": (["fx_base"], "SELECT project_id, min(url) AS start_url FROM fx_base GROUP BY project_id"),
    "fx_frontier": (["fx_sitemap", "fx_pages", "fx_projects"], "SELECT project_id,url FROM fx_sitemap UNION SELECT project_id,url FROM fx_pages UNION SELECT project_id,start_url FROM fx_projects"),
    "fx_digest": (["fx_fetch"], "SELECT project_id, url, status_code, h, title, description FROM (SELECT *, row_number() OVER (PARTITION BY project_id, url ORDER BY status_code=200 DESC, h DESC NULLS LAST, title DESC NULLS LAST, description DESC NULLS LAST, status_code DESC) AS dup_rn FROM (SELECT project_id, url, status_code, CASE WHEN status_code=200 THEN sha256(" + norm("body") + ") END AS h, CASE WHEN status_code=200 THEN " + title("body") + " END AS title, CASE WHEN status_code=200 THEN " + description("body") + " END AS description FROM fx_fetch)) WHERE dup_rn=1"),
    "fx_changes": (["fx_frontier", "fx_pages", "fx_revisions", "fx_digest"], """SELECT f.project_id,f.url, p.id AS page_id,
   CASE WHEN p.id IS NULL THEN 'new' WHEN x.url IS NULL OR x.status_code<>200 OR r.id IS NULL OR coalesce(r.content_sha256,'')='' OR r.content_sha256<>x.h THEN 'changed' ELSE 'unchanged' END AS change_class,
   CASE WHEN p.id IS NULL THEN NULL WHEN x.url IS NULL THEN 'Error checking content hash: fetch failed' WHEN x.status_code<>200 THEN concat('HTTP ',CAST(x.status_code AS STRING),' on full fetch')
     WHEN r.id IS NULL THEN 'No previous revision found' WHEN coalesce(r.content_sha256,'')='' THEN 'No stored content hash'
     WHEN r.content_sha256<>x.h THEN concat('Content hash changed: ',substring(r.content_sha256,1,8),'... -> ',substring(x.h,1,8),'...') ELSE 'No changes detected' END AS change_reason,
   r.id AS old_revision_id, r.content_sha256 AS old_content_sha256, x.url IS NOT NULL AS fetched, x.status_code, x.h AS content_sha256, x.title, x.description
   FROM fx_frontier f LEFT JOIN fx_pages p ON p.project_id=f.project_id AND p.url=f.url
   LEFT JOIN fx_revisions r ON r.id=p.current_revision_id
   LEFT JOIN fx_digest x ON x.project_id=f.project_id AND x.url=f.url"""),
    "fx_summary": (["fx_changes"], """SELECT project_id, count(*) FILTER (WHERE change_class='changed') AS n_changed,
   count(*) FILTER (WHERE change_class='new') AS n_new, count(*) FILTER (WHERE change_class='unchanged') AS n_unchanged,
   count(*) AS total_checked, bool_or(change_class IN ('changed','new')) AS has_changes FROM fx_changes GROUP BY project_id"""),
    "fx_webhook_events": ([], """SELECT event_id AS id, user_id AS webhook_id, 'run.complete' AS event_type, props AS payload, CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 204 WHEN 'view' THEN 302 WHEN 'signup' THEN 404 END AS status_code, CASE WHEN event_type='error' THEN 'Request timeout' ELSE NULL END AS response_body, ts AS attempted_at FROM events"""),
    "fx_webhooks": ([], "SELECT DISTINCT user_id AS id, user_id%50 AS project_id, concat('https://hook.example/',CAST(user_id AS STRING)) AS url, user_id%4<>0 AS is_active FROM events"),
    "fx_runs": ([], "SELECT o_orderkey AS id, o_custkey AS project_id, CASE WHEN o_orderstatus='F' THEN 'COMPLETE_WITH_DIFFS' WHEN o_orderstatus='O' THEN 'COMPLETE_NO_DIFFS' WHEN o_orderpriority='1-URGENT' THEN 'IN_PROGRESS' WHEN o_orderpriority='5-LOW' THEN 'FAILED' ELSE 'QUEUED' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus<>'P' AND o_orderkey%5<>0 THEN o_orderdate + INTERVAL 1 DAY ELSE NULL END AS finished_at, o_orderkey%3=0 AS is_scheduled FROM orders"),
    "fx_projects_tbl": ([], "SELECT c_custkey AS id, c_nationkey AS created_by, c_name AS name, concat('https://',lower(replace(c_name,'#','-')),'.example.com') AS domain FROM customer"),
    "fx_project_configs": ([], "SELECT c_custkey AS project_id, 2 AS crawl_depth, CASE c_mktsegment WHEN 'BUILDING' THEN '0 2 * * *' WHEN 'MACHINERY' THEN '0 2 * * 0' WHEN 'FURNITURE' THEN '5 4 * * *' ELSE NULL END AS cron_expression, c_acctbal>=0 AS is_enabled FROM customer WHERE c_custkey%10<>0"),
    "fx_artifacts": ([], "SELECT l_orderkey*10+l_linenumber AS id, l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'JSON' ELSE 'LLMS_TXT' END AS type, CASE WHEN l_linenumber%3=0 THEN NULL ELSE concat('https://store.example/public/llms_',CAST(l_orderkey AS STRING),'.txt') END AS public_url, CASE WHEN l_linenumber%2=0 THEN NULL ELSE concat('s3://llms-txt/llms_',CAST(l_orderkey AS STRING),'.txt') END AS storage_path, CAST(l_shipdate AS TIMESTAMP) AS created_at FROM lineitem"),
}


def with_fx(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the ``fx_*`` CTEs it references (in dependency order)
    and with extra ``(name, sql)`` CTEs (which may reference fx views)."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for dep in CTES[name][0]:
            visit(dep)
        needed.append(name)

    text_all = body + " ".join(sql for _, sql in extra)
    for name in CTES:
        if re.search(rf"\b{name}\b", text_all):
            visit(name)
    # nested references inside extra CTEs or fx CTEs are covered by visit()
    parts = [f"{n} AS ({CTES[n][1]})" for n in needed] + [f"{n} AS ({sql})" for n, sql in extra]
    stripped = body.lstrip()
    if parts and stripped[:5].upper() == "WITH ":
        # merge the body's own CTE list into ours
        return "WITH " + ",\n".join(parts) + ",\n" + stripped[5:]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def budget_cte(max_pages: int) -> tuple[str, str]:
    keep = f"rk <= {max_pages}" if max_pages >= 1 else "rk <= 1 AND is_start"
    return ("fx_budget", f"""SELECT * FROM (SELECT c.*, coalesce(c.url = CASE WHEN s.start_url LIKE 'http://%' OR s.start_url LIKE 'https://%' THEN s.start_url ELSE 'https://' || s.start_url END, false) AS is_start,
   row_number() OVER (PARTITION BY c.project_id ORDER BY coalesce(c.url = CASE WHEN s.start_url LIKE 'http://%' OR s.start_url LIKE 'https://%' THEN s.start_url ELSE 'https://' || s.start_url END, false) DESC,
     CASE c.change_class WHEN 'changed' THEN 0 ELSE 1 END, c.url, c.page_id ASC NULLS FIRST) AS rk
   FROM fx_changes c JOIN fx_projects s ON s.project_id = c.project_id WHERE c.change_class IN ('changed','new')) WHERE {keep}""")
