"""Jobs over stored pages and over captures of web content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions import html as H
from screenloom.functions import text as T
from screenloom.functions import web as W

MAX_TEXT, MAX_LINKS, MAX_IMAGES, MAX_URLS = 2000, 10, 5, 5
NOT_STORED = "page not stored"
# Fixed value: the note on a capture that failed.
NO_CONTENT = "No content to analyze"


def extract_pages(pages: DataFrame) -> DataFrame:
    """Title, text, links and images of each page, the last three cut to their caps.

    A page that is not stored gives a failure: only ``error`` says why, all parts are null.
    """
    seen, stored = pages.select("page_id", "url", H.visible(F.col("html")).alias("seen")), F.col("seen").isNotNull()
    seen = seen.select("*", H.tags_of(F.col("seen")).alias("tags"))
    return seen.select(
        "page_id", "url", F.when(stored, H.title_of(F.col("seen"))).alias("title"),
        F.when(stored, T.preview(H.text_of(F.col("seen")), MAX_TEXT, always=True)).alias("text_content"),
        F.slice(H.values_of(F.col("tags"), "a", "href"), 1, MAX_LINKS).alias("links"),
        F.slice(H.values_of(F.col("tags"), "img", "src"), 1, MAX_IMAGES).alias("images"),
        stored.alias("success"), F.when(~stored, NOT_STORED).alias("error"),
    )


def link_rows(pages: DataFrame) -> DataFrame:
    """Every link, before the cap."""
    return pages.select("page_id", F.posexplode(H.page_links(F.col("html"))).alias("pos", "href"))


def url_rows(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.posexplode(W.find_urls(F.col("text"))).alias("pos", "url"))


def analyze_web(captures: DataFrame, success: Column | None = None) -> DataFrame:
    """The analysis of captured web content; of a capture that failed only a note and no confidence.

    A text is read once for all needles, once for addresses and once for words; what follows from
    these is computed from columns. Without ``success`` a capture failed if it has no text.
    """
    read = captures.select(
        "capture_id", (F.col("text").isNotNull() if success is None else success).alias("success"), T.word_count(F.col("text")).alias("words"),
        F.coalesce(W.find_urls(F.col("text")), F.array().cast("array<string>")).alias("found"), W.bits_of(F.col("text")).alias("bits"),
    )
    read = read.select("*", W.web_by(F.col("bits")).alias("web"), W.categories_by(F.col("bits")).alias("kinds"))
    ok, urls, words, web = F.col("success"), F.col("found"), F.col("words"), F.col("web")
    return read.select(
        "capture_id", "success", F.when(~ok, NO_CONTENT).alias("analysis"), F.when(ok, words).alias("word_count"),
        F.when(ok, F.when(web, "web_browser").otherwise("unknown")).alias("content_type"), F.when(ok, F.size(urls) > 0).alias("has_urls"),
        F.when(ok, F.size(urls)).cast("long").alias("url_count"), F.when(ok, F.slice(urls, 1, MAX_URLS)).alias("urls"), F.when(ok, web).alias("is_web_content"),
        F.when(ok, F.col("kinds")).alias("categories"), F.when(ok, F.round(W.confidence(words, urls, web), 6)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, W.web_summary(words, urls, F.col("kinds"), web)).alias("summary"),
    )


def category_counts(captures: DataFrame) -> DataFrame:
    found = captures.select(F.explode(W.categories(F.col("text"))).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def enrich_first_url(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored page behind a capture's first URL; captures without one stay as they are."""
    first = captures.select("capture_id", F.get(W.find_urls(F.col("text")), F.lit(0)).alias("url"))
    known = pages.select("url", "page_id", H.page_title(F.col("html")).alias("title"))
    return first.join(known, "url", "left").select("capture_id", "url", "page_id", "title")
