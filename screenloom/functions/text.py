"""Scalar text functions: columns in, columns out, all on built-in expressions.

Patterns carry ``(?d)`` so that only ``\\n`` ends a line, and ``(?uU)`` for Unicode classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is deleted from a captured text, in this order.
NOISE = (
    r"https?://\S+",
    r"www\.\S+",
    r"^\s*\d+\s*$",
    r"©.*$",
    r"Page \d+ of \d+",
    r"Search\s*$",
    r"Menu\s*$",
    r"Home\s*$",
    r"filepath:.*$",
    r"PS C:\\.*>",
    r"\[.*?\]",
    r"Click here.*$",
    r"^\s*\d+\.\s*$",
    r"Share\s*$",
    r"Follow\s*$",
)
#: In every line that NOISE changes, but for lines of digits alone, one of these stands: in the line as it is, or in lower case.
#: None has an i, s or k, the only letters that other characters match when case is ignored.
SIGNS, LOW_SIGNS = ("://", "©", "["), ("www.", "page ", "earch", "menu", "home", "lepath:", " c:\\", " here", "hare", "follow")
# Words and phrases that make a text a question.
ASKING = ("what", "who", "when", "where", "why", "how")
REQUESTS = ("explain", "tell me", "describe", "define", "summarize")
QUESTION = r"(?iU)\b(who|what|when|where|why|how)\b|[?]"
NOTHING_LEFT = "No meaningful text found."


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def needle_bits(text: Column, needles: tuple[str, ...]) -> Column:
    """A number with a bit for each needle (63 at most) that the lower-case text has in it, inside words too."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a.bitwiseOR(b), [F.when(low.contains(n), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(needles)]))


def any_bit(bits: Column, needles: tuple[str, ...], wanted: tuple[str, ...]) -> Column:
    """Whether one of the wanted needles is in a text, from its bits."""
    return bits.bitwiseAND(F.lit(sum(1 << needles.index(n) for n in wanted)).cast("long")) != 0


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether the lower-case text has any of the strings in it, inside words too."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles])


#: All characters that are white space in Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends; only the ends are read."""
    return F.btrim(text, F.lit(SPACES))


def clean_line(line: Column) -> Column:
    """A line without noise; the patterns run only on a line with one of their signs."""

    def without_noise(x: Column) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, f"(?dmiuU){p}", ""), NOISE, x)

    raw = reduce(lambda a, b: a | b, [line.contains(n) for n in SIGNS])
    noisy = raw | let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [low.contains(n) for n in LOW_SIGNS]))
    return strip(F.when(noisy, without_noise(line)).otherwise(line))


def clean_text(text: Column) -> Column:
    """Noise deleted, short and wordless lines dropped, one line, spaces set around .,!?

    No pattern of noise takes anything but blank lines from two lines at once, so lines are
    cleaned one by one; a line of digits alone goes with the wordless ones.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), clean_line)
    lines = F.filter(lines, lambda x: (F.length(x) > 5) & x.rlike("[a-zA-Z]{3}"))
    out = F.array_join(lines, " ")
    out = F.regexp_replace(out, r"(?U)\s++([.,!?])", "$1")
    return strip(F.regexp_replace(out, r"(?U)([.,!?])(?=\S)", "$1 "))


def clean_lines(text: Column) -> Column:
    """Lines of five characters or more with a letter or digit; a fixed note if none is left."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\\R"), strip)
    kept = F.array_join(F.filter(lines, lambda x: (F.length(x) >= 5) & x.rlike("[a-zA-Z0-9]")), "\n")
    return F.when(kept == "", F.lit(NOTHING_LEFT)).otherwise(kept)


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def has_question(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(QUESTION)


def questions(text: Column) -> Column:
    """The sentences that ask."""
    return F.filter(sentences(text), lambda s: s.rlike(QUESTION))


def prompt_kind(text: Column) -> Column:
    """question or summary, by marks, question words or requests anywhere in the text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("?") | contains_any(text, ASKING + REQUESTS), "question").otherwise("summary")


def plain_prompt_kind(text: Column) -> Column:
    """The older rule: only a question mark makes a question."""
    return F.when(text.contains("?"), "question").otherwise("summary")


def preview(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters and an ellipsis; without ``always`` only where something is cut."""
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)


def latin1(text: Column) -> Column:
    """Characters beyond Latin-1 become question marks."""
    return F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?")


def after_colon(line: Column) -> Column:
    """What follows the first colon, or the whole line without one."""
    at = F.instr(line, ":")
    return strip(F.when(at > 0, line.substr(at + 1, F.length(line))).otherwise(line))
