"""Web content: URLs in text, page parts from stored HTML, content categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.text import any_bit, needle_bits

URL = r"""https?://[^\s<>"\[\]{}|\\^`]+"""
# Signs of web content, and words of each category in their order.
WEB_SIGNS = ("http", "www", ".com", ".org", ".net", "search", "home", "about", "contact")
CATEGORIES = (
    ("Authentication", ("login", "sign in", "password", "username")),
    ("E-commerce", ("shop", "buy", "cart", "price", "product")),
    ("News/Article", ("news", "article", "posted", "published")),
    ("Search Results", ("search", "results", "found")),
    ("Video Content", ("video", "play", "watch", "subscribe")),
)


#: All of these, for one reading of a text.
NEEDLES = tuple(dict.fromkeys(WEB_SIGNS + tuple(w for _, words in CATEGORIES for w in words)))


def find_urls(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.contains("://"), F.regexp_extract_all(text, F.lit(URL), F.lit(0))).otherwise(none)


def bits_of(text: Column) -> Column:
    """Which of the needles a text holds."""
    return needle_bits(F.coalesce(text, F.lit("")), NEEDLES)


def web_by(bits: Column) -> Column:
    return any_bit(bits, NEEDLES, WEB_SIGNS)


def categories_by(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_bit(bits, NEEDLES, words), name) for name, words in CATEGORIES]))


def is_web(text: Column) -> Column:
    return web_by(bits_of(text))


def categories(text: Column) -> Column:
    return F.transform(F.array(bits_of(text)), categories_by)[0]


def confidence(words: Column, urls: Column, web: Column) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.2) + add(words > 0, 0.2) + add(F.size(urls) > 0, 0.3) + add(web, 0.3))


def web_summary(words: Column, urls: Column, kinds: Column, web: Column) -> Column:
    """The wording of a summary is part of the record."""
    words = words.cast("string")
    told = F.concat(
        F.lit("Web content detected with "), words, F.lit(" words"),
        F.when(F.size(urls) > 0, F.concat(F.lit(" and "), F.size(urls).cast("string"), F.lit(" URLs"))).otherwise(F.lit("")),
        F.when(F.size(kinds) > 0, F.concat(F.lit(". Categories: "), F.array_join(kinds, ", "))).otherwise(F.lit("")),
    )
    return F.when(web, told).otherwise(F.concat(F.lit("Non-web content with "), words, F.lit(" words")))
