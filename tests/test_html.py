"""The page tokenizer on literal pages, character references against the standard library's table."""

import html as standard
import random

from pyspark.sql import functions as F

from screenloom.functions import html as H
from screenloom.operators import web


def cut(spark, *pages):
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return web.extract_pages(rows).orderBy("page_id").collect()


def test_quotes_hide_what_looks_like_markup(spark):
    page = """<a title="x > y" href='/one'>a</a><a title="b href=/no c" href="/two">b</a><A HREF=/three>c</A>"""
    comments = '<a title="<!-- " href=/x>1</a><!-- <a href="no"> --><a href="/y" title=" -->">2</a><img alt="<img src=no>" src = yes.png>'
    odd = "<a title=it's href=/q>d</a><a data-href=no>e</a><a href>f</a><abbr href=no>g</abbr><a\nhref='/n'\n>h</a><a title=\"t\"href=/glued>i</a><a href=1 href=2>j</a><a/href=/slash>k</a>"
    one, two, three = cut(spark, page, comments, odd)
    assert (one.links, one.text_content) == (["/one", "/two", "/three"], "abc...")
    assert (two.links, two.images, two.text_content) == (["/x", "/y"], ["yes.png"], "12...")
    assert (three.links, three.text_content) == (["/q", "", "/n", "/glued", "2", "/slash"], "defghijk...")


def test_scripts_styles_and_templates_are_no_text(spark):
    script = "a<script>if (a < b) '</style>' <a href=no></script>b<STYLE >x</script></style>c<script src='>'>z</script >d"
    nested = "a<template>x<template>y</template>z<a href=/in>w</a></template>b</template>c"
    never = ("a<script>b", "a<!-- b", "a<template>b", "a < b <c", "")
    rows = cut(spark, script, nested, *never)
    assert [r.text_content for r in rows] == [t + "..." for t in ("abcd", "abc", "a", "a", "a", "a < b <c", "")]
    assert rows[0].links == [] and rows[1].links == ["/in"]


def test_titles_and_failures(spark):
    rows = cut(spark, "<TITLE lang='>'>a &amp; b</TITLE>", "<title></title>", "<title>a<b>c</b></title>", "<!-- <title>no</title> --><p>x", "<titles>no</titles>", None)
    assert [r.title for r in rows] == ["a & b", None, None, H.NO_TITLE, H.NO_TITLE, None]
    last = rows[-1]
    assert (last.success, last.error, last.text_content, last.links, last.images) == (False, web.NOT_STORED, None, None, None)
    assert all(r.success and r.error is None for r in rows[:-1])


def test_references_are_the_standards(spark):
    rng = random.Random(3)
    names = sorted(H.html5)
    texts = ["&#39;&nbsp;&eacute;&apos;&#x41;&#X41", "&amp;lt; &am&amp;p; & && &; &#; &#x; &x &notit; &notin; &ampx", "&#0;&#128;&#150;&#129;&#11;&#xD800;&#x110000;&#99999999999999999999;&#xFDD0;&#13;&#x1F600;&#65534;"]
    for _ in range(200):
        part = lambda: rng.choice(["&" + rng.choice(names), "&#" + str(rng.choice([rng.randint(0, 300), rng.randint(0, 1200000)])), "&#x%x" % rng.randint(0, 0x11FFFF), "text ", ";", "&", "x"])
        texts.append("".join(part() for _ in range(8)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.decoded(F.col("t")).alias("d")).collect()
    for r in rows:
        assert r.d == standard.unescape(r.t), r.t


def test_addresses_keep_their_parameters(spark):
    assert cut(spark, '<a href="?a=1&copy=2&amp;b=3&lt;&#65">x</a>')[0].links == ["?a=1&copy=2&b=3<A"]


def test_text_that_meets_over_a_tag_is_no_reference(spark):
    assert cut(spark, "&am<b>p;</b>&l<!-- -->t;")[0].text_content == "&amp;&lt;..."


def test_large_pages_and_no_python(spark):
    big = "<p>" + "<b a='x'>word</b> " * 30_000 + '<img src="data:' + "x" * 500_000 + '">' + "<a " + "b=c " * 20_000 + "href=/end>"
    row = cut(spark, big)[0]
    assert row.links == ["/end"] and len(row.images[0]) == 500_005 and len(row.text_content) == 2003
    plan = web.extract_pages(spark.createDataFrame([(1, "u", "x")], "page_id int, url string, html string"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
