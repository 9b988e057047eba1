"""Title, description, visible text and character references."""

import hashlib
import html
import random
from html.entities import html5

import pytest

from sitewatch.functions import text
from sitewatch.operators.changes import digest_snapshot


def every(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_references_like_the_standard_library(spark):
    rnd = random.Random(4)
    names = list(html5)
    values = ["&ltimes;", "&copysr;", "&#38;amp;", "&notit;", "R&D", "&&amp;", "&amp;lt;", "&#150;&#0;&#xD800;&#x110000;&#1;", "&#39&#390;", "", "plain"]
    values += ["".join(rnd.choice([f"&{rnd.choice(names)}", f"&{rnd.choice(names)[:-1]}", f"&#{rnd.randrange(0x11FFFF)};", "&", "x", ";", " "])
                       for _ in range(8)) for _ in range(300)]
    assert every(spark, text.decode_entities, values) == [html.unescape(v) for v in values]


@pytest.mark.parametrize("page, want", [
    ("<ul><li>one</li><li>two</li></ul>", "onetwo"), ("  a \n\t b&nbsp;&nbsp;c ", "a b c"), ("<p>5 < 6 and 7 > 2</p>", "5 < 6 and 7 > 2"),
    ('<a title="1>0" href=x>kept</a>', "kept"), ("<p title=don't>kept</p>", "kept"), ("<b>a</b><script>gone", "a"), ("a<!-- gone", "a"),
    ("<STYLE media='x>y'>gone</STYLE >b", "b"), ("x<noscript>gone</noscript><iframe src=y>gone</iframe>y", "xy"),
    ("<scripted>kept</scripted>", "kept"), ("", ""),
])
def test_visible_text(spark, page, want):
    assert every(spark, text.visible_text, [page]) == [want]
    assert every(spark, text.fingerprint, [page]) == [hashlib.sha256(want.encode()).hexdigest()]


def test_titles_and_descriptions(spark):
    pages = {"<title> Fish &amp; Chips </title><title>2</title>": ("Fish & Chips", ""), "<!--<title>a</title>--><TITLE lang=x>b</TITLE>": ("b", ""),
             "<p>none</p>": ("", ""), "<meta content='c' name='description'>": ("", "c"), "<meta data-name='description' content=no>": ("", ""),
             "<meta name=description data-content=no content=yes>": ("", "yes"), "<meta name='Description' content='no'>": ("", ""),
             "<meta name='description' content=''><meta name='description' content='late'>": ("", "")}
    assert list(zip(every(spark, text.title, pages), every(spark, text.description, pages))) == list(pages.values())


def test_digest_stays_in_the_jvm(spark):
    rows = [("p", "u", 200, "<title>Caf&eacute;</title><p>A&hellip;</p>"), ("p", "gone", 404, "<p>x</p>"), ("p", "u", 500, "later")]
    digest = digest_snapshot(spark.createDataFrame(rows, "project_id string, url string, status_code int, body string"))
    assert "Python" not in digest._jdf.queryExecution().toString()
    got = {r["url"]: r for r in digest.collect()}
    assert got["u"]["content_sha256"] == hashlib.sha256("CaféA…".encode()).hexdigest() and got["u"]["title"] == "Café"
    assert got["gone"]["content_sha256"] is None and got["gone"]["status_code"] == 404
