"""What a capture shows, from its process name and text: first match of ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.text import any_bit, contains_any, let, needle_bits, word_count

# Process names of a family, in the order they are tried.
FAMILIES = (
    ("browser", ("chrome.exe", "firefox.exe", "edge.exe", "safari.exe", "opera.exe")),
    ("editor", ("notepad.exe", "code.exe", "notepad++.exe", "sublime_text.exe", "atom.exe")),
    ("file_manager", ("explorer.exe", "totalcmd.exe")),
)
# Name parts of an application category, in the order they are tried.
CATEGORIES = (
    ("browser", ("chrome", "firefox", "edge", "safari")),
    ("editor", ("code", "notepad", "sublime", "atom")),
    ("office", ("word", "excel", "powerpoint", "outlook")),
    ("media", ("vlc", "spotify", "photoshop")),
    ("development", ("visual studio", "pycharm", "intellij")),
    ("communication", ("teams", "slack", "discord", "zoom")),
)
# Capabilities of applications, in the order they are tried.
CAPABILITIES = (
    ("chrome", ("web_browsing", "javascript", "extensions")),
    ("code", ("text_editing", "syntax_highlighting", "debugging")),
    ("word", ("document_creation", "formatting", "collaboration")),
    ("excel", ("spreadsheets", "calculations", "charts")),
    ("photoshop", ("image_editing", "layers", "filters")),
)
# Words in a user's actions, in the order they are tried.
ACTIVITIES = (
    ("content_creation", ("type", "edit", "write")),
    ("information_seeking", ("click", "navigate", "browse")),
    ("development", ("debug", "compile", "test")),
)
# Productivity of an activity.
SCORES = (
    (8, ("Programming", "Document Editing", "Data Analysis")),
    (6, ("Email Management", "Web Search")),
    (5, ("Reading/Writing", "Web Browsing")),
    (2, ("Video Streaming",)),
)


def first_match(text: Column, rules, otherwise: str) -> Column:
    """The name of the first rule with a needle in the text."""
    out = F.lit(otherwise)
    for name, needles in reversed(rules):
        out = F.when(contains_any(text, needles), F.lit(name)).otherwise(out)
    return out


def app_family(process: Column) -> Column:
    return first_match(process, FAMILIES, "generic")


def app_category(process: Column) -> Column:
    return first_match(process, CATEGORIES, "unknown")


def usage_intensity(cpu: Column, memory: Column) -> Column:
    cpu, memory = F.coalesce(cpu, F.lit(0.0)), F.coalesce(memory, F.lit(0))
    return (
        F.when((cpu > 50) | (memory > 500_000_000), "high").when((cpu > 10) | (memory > 100_000_000), "medium").otherwise("low")
    )


def capabilities(process: Column) -> Column:
    out = F.array(F.lit("general_purpose"))
    for name, what in reversed(CAPABILITIES):
        out = F.when(F.lower(process).contains(name), F.array(*map(F.lit, what))).otherwise(out)
    return out


def user_activity(actions: Column) -> Column:
    """From an array of action descriptions."""
    return F.when(F.size(actions) <= 0, "unknown").otherwise(first_match(F.array_join(actions, " "), ACTIVITIES, "general_use"))


# What an application's name, a browser's text and any other text say, in the order they are tried.
APP_RULES = (
    (("chrome", "firefox", "edge"), "Web Browser", None),
    (("code", "visual", "studio"), "Development Environment", "Programming"),
    (("word", "notepad"), "Document Editor", "Document Editing"),
    (("excel", "calc"), "Spreadsheet", "Data Analysis"),
    (("outlook", "mail"), "Email Client", "Email Management"),
)
BROWSING_RULES = (
    (("search", "google", "results"), "Web Search"),
    (("email", "gmail", "inbox"), "Email"),
    (("youtube", "video", "play"), "Video Streaming"),
)
TEXT_RULES = (
    (("http", "www"), "Web Content", "General"),
    (("function", "class", "import", "def", "var", "const"), "Source Code", "Programming"),
    (("document", "paragraph", "chapter", "section"), "Document", "Reading/Writing"),
)
APP_NEEDLES = tuple(n for needles, *_ in APP_RULES for n in needles)
TEXT_NEEDLES = tuple(n for needles, *_ in BROWSING_RULES + TEXT_RULES for n in needles)


def detect_activity(process: Column, text: Column) -> Column:
    """Struct of content_type and activity_type: the application decides, else the text, which is read once."""

    def pair(content: str, activity: str | Column) -> Column:
        return F.struct(F.lit(content).alias("content_type"), (F.lit(activity) if isinstance(activity, str) else activity).alias("activity_type"))

    def decide(both: Column) -> Column:
        app = lambda needles: any_bit(both["app"], APP_NEEDLES, needles)
        says = lambda needles: any_bit(both["text"], TEXT_NEEDLES, needles)
        browsing, out = F.lit("Web Browsing"), pair("Unknown", "General")
        for needles, activity in reversed(BROWSING_RULES):
            browsing = F.when(says(needles), activity).otherwise(browsing)
        for needles, content, activity in reversed(TEXT_RULES):
            out = F.when(says(needles), pair(content, activity)).otherwise(out)
        for needles, content, activity in reversed(APP_RULES):
            out = F.when(app(needles), pair(content, browsing if activity is None else activity)).otherwise(out)
        return out

    read = F.struct(
        needle_bits(F.coalesce(process, F.lit("")), APP_NEEDLES).alias("app"), needle_bits(F.coalesce(text, F.lit("")), TEXT_NEEDLES).alias("text")
    )
    return let(read, decide)


def productivity_score(activity: Column) -> Column:
    out = F.lit(4)
    for score, names in SCORES:
        out = F.when(activity.isin(*names), F.lit(score)).otherwise(out)
    return out


def time_period(ts_s: Column) -> Column:
    hour = F.pmod(F.floor(ts_s / 3600), F.lit(24))
    return F.when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 200)).cast("long")


def suggestions(score: Column, text: Column) -> Column:
    """Array of hints in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(score < 5, "low_score"),
            F.when(word_count(text) > 500, "long_text"),
            F.when(contains_any(text, ("error", "exception")), "error_seen"),
        )
    )
