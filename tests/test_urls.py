"""URL functions; link resolution is held against the standard library."""

import random
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from sitewatch.functions import urls
from sitewatch.plans.queries_sources import LINK_FORMS


def joined(base, link):
    if not link:
        return None
    link = link.strip()
    if link.startswith(("mailto:", "tel:", "javascript:")):
        return None
    got = urldefrag(urljoin(base, link))[0]
    return got if urlparse(got).scheme in ("http", "https") else None


def test_links_resolve_like_the_standard_library(spark):
    rnd = random.Random(8)
    bases = ["http://a/b/c/d;p?q", "https://a.org", "https://a.org/", "https://A.org:81/x/y/z?k=v", "http://a/x/./y/../z"]
    links = LINK_FORMS + ["\n/x\n", " //h/p ", "https:", "x:y"]
    links += ["".join(rnd.choice(["a", "b/", "../", "./", "/", "?q=1", "#f", ";p"]) for _ in range(rnd.randrange(1, 6))) for _ in range(150)]
    pairs = [(b, x) for b in bases for x in links if not x.startswith(("http:", "https:")) or "//" in x]
    df = spark.createDataFrame([*pairs, (bases[0], None)], "b string, l string")
    for b, x, got in df.select("b", "l", urls.resolve_link("b", "l")).collect():
        assert got == joined(b, x), (b, x)


def test_hosts(spark):
    pairs = [("http://one.org/a", "https://one.org:99/b", True), ("http://One.ORG", "http://one.org/?q", True),
             ("http://one.org", "http://www.one.org", False), ("http://u:p@one.org", "http://one.org", True), ("/path", "x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(w == g for w, g in df.select("want", urls.same_host("a", "b")).collect())


def test_scheme_path_and_roots(spark):
    rows = [("one.org/x", "https://one.org/x"), ("http://one.org", "http://one.org"), ("", ""), (None, None), ("ftp://one.org", "https://ftp://one.org")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(w == g for w, g in df.select("want", urls.ensure_scheme("u")).collect())
    df = spark.createDataFrame([("http://one.org:81",), ("http://one.org:81/p/q?r#s",)], "u string")
    got = df.select(urls.page_path("u"), urls.well_known("u", "robots.txt")).collect()
    assert [tuple(r) for r in got] == [("/", "http://one.org:81/robots.txt"), ("/p/q", "http://one.org:81/robots.txt")]


def test_valid_addresses(spark):
    good = ["https://one.org", "http://one.org:80/x?y#z", "https://[::1]/", "https://u:p@host/", "https://localhost"]
    bad = ["https://", "one.org", "ftp://one.org", "https://one org", "https://[::1", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in df.select(urls.is_valid_url("u")).collect()] == [True] * len(good) + [False] * len(bad)
    df = spark.createDataFrame([("one.org",), ("https://one.org",)], "u string").select(F.collect_list(urls.normalize_domain("u")))
    assert df.first()[0] == ["https://one.org", "https://one.org"]
