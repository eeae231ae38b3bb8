"""Entities that a cut text ends in, and numbers that begin like an error's."""

import html

from pyspark.sql import functions as F

from rolegrain.functions import text, validity
from rolegrain.sources import elements

CUT = ["A &amp;&amp;&amp", "A &am", "B&nbsp;&copy;&copy x", "&#38;&#38 &#x26;&#x26", "&amp;amp; &ampfoo; &", "a&amp;lt;&quot;b&quot"]


def test_plain_text_of_cut_references(spark):
    rows = spark.createDataFrame([(t,) for t in CUT], "t string").select("t", text.plain_text(F.col("t")).alias("any"), text.plain_text(F.col("t"), bare=False).alias("closed")).collect()
    assert [r.any for r in rows] == [" ".join(html.unescape(t).split()) for t in CUT]
    assert [r.closed for r in rows] == ["A &&&amp", "A &am", "B ©&copy x", "&&#38 &&#x26", "&amp; &ampfoo; &", 'a&lt;"b&quot']


def test_longer_numbers_are_no_errors(spark):
    urls = {"https://x.test/404": "not_found", "https://x.test/errors/404?a=1": "not_found", "https://x.test/404.html": "not_found", "https://x.test/404-not-found": "not_found", "https://x.test/4040": None, "https://x.test/jobs/40412": None, "https://x.test/4040/404": "not_found"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", validity.failed_page(F.lit("Jobs"), F.col("u")).alias("f")).collect()
    assert {r.u: r.f for r in rows} == urls


def test_headings_of_cut_references(spark):
    page = '<style>p{a:"&lt"}</style><script>if (a && b &lt c) x()</script><!-- & --><h1>C &amp;&amp;&amp</h1><p><a href="/x?a=1&copy=2&amp;b=3">go</a></p>'
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    link, heading = F.col("tag") == "a", F.col("tag") == "h1"
    at = lambda **how: [(r.href, r.heading) for r in elements.headings_of(pages, link, heading, **how).collect()]
    assert at(bare=False) == [("/x?a=1&copy=2&b=3", "C &&&amp")] and [h for _, h in at()] == ["C &&&"]
    said = lambda **how: [r.text for r in elements.elements(pages, **how).filter("tag in ('script', 'style')").orderBy("node").collect()]
    assert said(bare=False) == said() == ['p{a:"&lt"}', "if (a && b &lt c) x()"]
