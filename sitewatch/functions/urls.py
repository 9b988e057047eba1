"""URL expressions: scheme, parts, link resolution, host comparison.

URLs are split with the generic-syntax regular expression of RFC 3986
(appendix B) instead of a URI parser, so malformed input gives empty parts and
never an exception inside a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
DEFAULT_SCHEME_PREFIX = "https://"
REJECTED_LINK_PREFIXES = ("mailto:", "tel:", "javascript:")
ALLOWED_SCHEMES = ("http", "https")
# Client-side form check for a project domain (stricter than the server check).
FORM_URL_RE = (r"^https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
               r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$")
# ---------------------------------------------------------------------------

URI_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PART = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_part(url, part: str) -> Column:
    """'' when the part is absent (like ``urlparse``)."""
    return F.regexp_extract(_col(url), URI_RE, _PART[part])


def has_query(url) -> Column:
    return _col(url).rlike(r"^[^#]*\?")


def has_fragment(url) -> Column:
    return F.instr(_col(url), "#") > 0


def hostname(url) -> Column:
    """Host without user info and port, lower-cased; null when there is none."""
    host = F.regexp_extract(url_part(url, "netloc"), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    host = F.regexp_replace(host, r"^\[|\]$", "")
    return F.when(host == "", F.lit(None)).otherwise(F.lower(host))


def ensure_scheme(url) -> Column:
    """Prefix https:// unless the URL starts with http:// or https://; null/'' unchanged."""
    u = _col(url)
    return (F.when(u.isNull() | (u == ""), u)
            .when(u.startswith("http://") | u.startswith("https://"), u)
            .otherwise(F.concat(F.lit(DEFAULT_SCHEME_PREFIX), u)))


def same_host(a, b) -> Column:
    """Host names equal, port and scheme ignored, case-insensitive."""
    return hostname(a).eqNullSafe(hostname(b))


def page_path(url) -> Column:
    """Path of a URL, '/' when empty."""
    p = url_part(url, "path")
    return F.when(p == "", F.lit("/")).otherwise(p)


def well_known(url, name: str) -> Column:
    """P10: ``{scheme}://{netloc}/{name}``; netloc keeps the port."""
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "netloc"), F.lit("/" + name))


def netloc(url) -> Column:
    return url_part(url, "netloc")


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 on an absolute path, with arrays (no UDF)."""
    segs = F.split(path, "/")
    tail = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    stack = F.aggregate(
        tail, F.array().cast("array<string>"),
        lambda acc, s: (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s)))))
    last = F.element_at(segs, -1)
    stack = F.when(last.isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def resolve_link(base, link) -> Column:
    """Resolve ``link`` against ``base`` like the standard library's ``urljoin``,
    drop the fragment.

    Null for empty links, mailto:/tel:/javascript: and any non-http(s) result.
    Line ends and tabs inside a link are dropped, an absolute link keeps its
    path as written, and an empty query ("?") counts as none.  A link of another
    scheme than the base's stays as it is; otherwise the scheme goes to lower case.
    """
    b, raw = _col(base), _col(link)
    trimmed = F.regexp_replace(raw, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    l = F.regexp_replace(trimmed, r"^[\x00-\x20]+|[\t\r\n]+", "")
    b_scheme, b_netloc = F.lower(url_part(b, "scheme")), url_part(b, "netloc")
    b_path, b_query = url_part(b, "path"), url_part(b, "query")
    l_scheme, l_netloc = F.lower(url_part(l, "scheme")), url_part(l, "netloc")
    l_path, l_query = url_part(l, "path"), url_part(l, "query")
    b_dir = F.when(b_path == "", F.lit("/")).otherwise(F.regexp_extract(b_path, r"^(.*/)", 1))
    b_dir = F.when(b_dir == "", F.lit("/")).otherwise(b_dir)

    def with_query(head, query):
        return F.when(query != "", F.concat(head, F.lit("?"), query)).otherwise(head)

    def slashed(path):
        return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))

    origin = F.concat(b_scheme, F.lit("://"), b_netloc)
    other_scheme = (l_scheme != "") & (l_scheme != b_scheme)
    resolved = (
        F.when(other_scheme & ~has_fragment(l), l)
        .when(other_scheme | (l_netloc != ""),
               with_query(F.concat(F.when(l_scheme == "", b_scheme).otherwise(l_scheme),
                                   F.when(l_netloc == "", F.lit(":")).otherwise(F.concat(F.lit("://"), l_netloc)),
                                   F.when(l_netloc == "", l_path).otherwise(slashed(l_path))), l_query))
        .when(l_path.startswith("/"), with_query(F.concat(origin, _remove_dot_segments(l_path)), l_query))
        .when(l_path == "", with_query(F.concat(origin, slashed(b_path)), F.when(l_query != "", l_query).otherwise(b_query)))
        .otherwise(with_query(F.concat(origin, _remove_dot_segments(
            F.regexp_replace(F.concat(b_dir, l_path), "/{2,}", "/"))), l_query)))
    rejected = raw.isNull() | (raw == "")
    for p in REJECTED_LINK_PREFIXES:
        rejected = rejected | trimmed.startswith(p)
    ok_scheme = F.lower(url_part(resolved, "scheme")).isin(*ALLOWED_SCHEMES)
    return F.when(rejected | ~ok_scheme, F.lit(None).cast("string")).otherwise(resolved)


def normalize_domain(domain) -> Column:
    """Prefix https:// unless the text already starts with 'http'."""
    d = _col(domain)
    return F.when(d.startswith("http"), d).otherwise(F.concat(F.lit(DEFAULT_SCHEME_PREFIX), d))


# http(s) scheme, optional user info, a host name or bracketed IPv6 address, optional port, a rest without blanks.
VALID_URL_RE = r"(?i)^https?://(?:[^\s/?#@]*@)?(?:\[[0-9a-f:.]+\]|[^\s/?#@:\[\]]+)(:[0-9]*)?([/?#][^\s]*)?$"


def is_valid_url(url) -> Column:
    """Server-side check: an http(s) URL with a non-empty host and no blanks."""
    return F.coalesce(_col(url).rlike(VALID_URL_RE), F.lit(False))


def form_url_ok(url) -> Column:
    """Client-side form regex for a domain."""
    return _col(url).rlike(FORM_URL_RE)
