"""Parts of stored HTML pages, cut out by one tokenizer that is written as column expressions.

A page is cut into comments, declarations, scripts and styles with all they hold, tags whose
attribute values may be quoted, and text. Patterns take over what ``html`` holds token by token,
so that a ``>``, a ``<!--`` or an attribute's name inside a quoted value means nothing.

What is malformed is text: a ``<`` that begins no token, a tag that never ends. Comments, scripts,
styles and templates that never end reach to the end of the page.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.text import let

NO_TITLE = "No title"
#: Stands where a token was taken out, so that the text on its two sides does not run together; U+0001 is in no valid page.
CUT = "\u0001"


def tag(names: str = "[a-z][^\\s/>]*", end: str = "/?", hold: str = "+") -> str:
    """A tag; a quote counts only behind ``=``. ``hold`` keeps the matcher from trying other cuts, where it can."""
    return rf"""<{end}{names}(?:[\s/](?:[^=>]+{hold}|=\s*{hold}(?:"[^"]*"|'[^']*'|[^\s>]*{hold}))*{hold})?>"""


def hidden(hold: str = "+") -> str:
    """What is no part of a page's text or tags."""
    whole = [rf"{tag(name, '', hold)}.*?(?:</{name}[^>]*>|\z)" for name in ("script", "style")]
    return "|".join([r"<!--.*?(?:-->|\z)", "<![^>]*>", r"<\?[^>]*>", *whole])


#: Cuts a tag into its name and its attributes, so that a name inside a value is not found.
ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""


def attribute(name: str) -> str:
    """An attribute of a name, out of those of ``ATTRIBUTE``."""
    return rf"(?is)^{name}(?:\s*=|$)"


# --- character references

REFERENCE = "&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"
#: Names that count without a semicolon too; from the standard's table, as all names.
BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
NAMES = dict(sorted(html5.items(), key=lambda x: (len(x[0]), x[0])))
#: What the numbers 128 to 159 stand for: the code page that pages with such numbers mean.
WESTERN = {n: bytes([n]).decode("cp1252", "replace").replace("�", chr(n)) for n in range(128, 160)}


def named(reference: Column) -> Column:
    """The characters of ``&name;``; of its longest beginning that needs no semicolon, if the name is none."""
    table = F.str_to_map(F.lit("\u0003".join(f"{k}\u0002{v}" for k, v in NAMES.items())), F.lit("\u0003"), F.lit("\u0002"))
    bare = F.regexp_extract(reference, f"^&({BARE})", 1)
    part = F.concat(F.try_element_at(table, bare), F.substr(reference, F.length(bare) + 2))
    return F.coalesce(F.try_element_at(table, F.substring(reference, 2, 64)), F.when(bare != "", part), reference)


def numbered(digits: Column, base: int) -> Column:
    """The character of a number: a replacement for impossible ones, nothing for control characters."""
    own = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(own) > 7, F.lit(0x110000)).when(own == "", F.lit(0)).otherwise(F.conv(own, base, 10).cast("int"))

    def character(n: Column) -> Column:
        control = n.between(1, 8) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n == 11) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        western = F.element_at(F.array(*[F.lit(WESTERN[i]) for i in range(128, 160)]), n - 127)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
            .when(n == 13, "\r").when(n.between(128, 159), western).when(control, "").otherwise(plain)
        )

    return let(number, character)


def decoded(text: Column, name=named) -> Column:
    """Character references replaced, in one pass from left to right."""

    def one(t: Column) -> Column:
        return (
            F.when(t.rlike("^&#[xX]"), numbered(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
            .when(t.startswith("&#"), numbered(F.regexp_extract(t, "^&#([0-9]*)", 1), 10))
            .when(t.rlike("^&[A-Za-z]"), name(t)).otherwise(t)
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda t: F.when(t.rlike("^&."), one(t)).otherwise(t))
    return F.when(text.contains("&"), F.array_join(found, "")).otherwise(text)


def closed_only(reference: Column) -> Column:
    """Names in addresses need their semicolon: ``?a=1&copy=2`` holds none."""
    return F.when(reference.endswith(";"), named(reference)).otherwise(reference)


# --- parts of a page


def visible(html: Column) -> Column:
    """A page without comments, declarations, scripts and styles; tags are kept."""
    return F.regexp_replace(html, f"(?is){hidden()}|({tag()})", f"$1{CUT}")


def outside_templates(seen: Column) -> Column:
    """A page without its templates, which may hold templates: a fold over tags and text with the depth as state."""
    tokens = F.regexp_extract_all(seen, F.lit(f"(?is){tag()}|[^<]+|<"), F.lit(0))
    step = lambda t: F.when(t.rlike(r"(?i)^<template[\s/>]"), 1).when(t.rlike(r"(?i)^</template[\s/>]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def fold(at: Column, t: Column) -> Column:
        depth = F.greatest(F.lit(0), at["depth"] + step(t))
        inside = (depth > 0) | (at["depth"] > 0)
        return F.struct(depth.alias("depth"), F.when(inside, at["kept"]).otherwise(F.concat(at["kept"], F.array(t))).alias("kept"))

    folded = F.array_join(F.aggregate(tokens, start, fold, lambda at: at["kept"]), "")
    return F.when(seen.rlike(r"(?i)<template[\s/>]"), folded).otherwise(seen)


def text_of(seen: Column) -> Column:
    return F.replace(decoded(F.regexp_replace(outside_templates(seen), f"(?is){tag()}", CUT)), F.lit(CUT), F.lit(""))


def title_of(seen: Column) -> Column:
    """The first title; null if it is empty or holds tags, and a fixed note if there is none."""
    begin = tag("title", "")
    own = F.replace(F.regexp_extract(seen, rf"(?is){begin}([^<]*)</title[\s/>]", 1), F.lit(CUT), F.lit(""))
    return F.when(seen.rlike(f"(?is){begin}"), F.when(own != "", decoded(own))).otherwise(F.lit(NO_TITLE))


def tags_of(seen: Column) -> Column:
    """The tags that may hold a link or an image."""
    return F.filter(F.regexp_extract_all(seen, F.lit(f"(?is){tag()}"), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:a|img)[\s/]"))


def values_of(tags: Column, name: str, attr: str) -> Column:
    """An attribute's values in all tags of a name, in order; of an attribute given twice the last."""
    own = F.transform(F.filter(tags, lambda t: t.rlike(rf"(?i)^<{name}[\s/]")), lambda t: F.get(F.reverse(F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(attribute(attr)))), F.lit(0)))
    value = lambda x: F.regexp_replace(x, rf"""(?is)^{attr}(?:\s*=\s*(?:"(.*)"|'(.*)'|(.*)))?$""", "$1$2$3")
    return F.transform(F.array_compact(own), lambda x: decoded(value(x), closed_only))


def page_title(html: Column) -> Column:
    return F.when(html.isNotNull(), title_of(visible(html)))


def page_text(html: Column) -> Column:
    return text_of(visible(html))


def page_links(html: Column) -> Column:
    return values_of(tags_of(visible(html)), "a", "href")


def page_images(html: Column) -> Column:
    return values_of(tags_of(visible(html)), "img", "src")
