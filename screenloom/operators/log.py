"""Jobs over the action log and over captures as context: top-N, time range, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.functions import activity as A
from screenloom.functions import text as T

RECENT = 10


def newest_first(key: str) -> Window:
    return Window.partitionBy(key).orderBy(F.desc("ts_s"), F.desc("id"))


def recent_actions(actions: DataFrame, app: str, n: int = RECENT) -> DataFrame:
    """The latest actions of one application (exact name), newest first."""
    return actions.filter(F.col("application") == app).orderBy(F.desc("ts_s"), F.desc("id")).limit(n).select("id", "ts_s", "description")


def top_n_per_key(actions: DataFrame, key: str = "application", n: int = RECENT) -> DataFrame:
    """The latest n of every key; each task keeps n a key before the shuffle."""
    return actions.withColumn("rn", F.row_number().over(newest_first(key))).filter(F.col("rn") <= n)


def recent_lists(actions: DataFrame, key: str = "application", n: int = RECENT) -> DataFrame:
    """key, recent: descriptions of the latest actions, newest first; n a key at most."""
    pairs = F.sort_array(F.collect_list(F.struct("rn", "description")))
    return top_n_per_key(actions, key, n).groupBy(key).agg(F.transform(pairs, lambda x: x["description"]).alias("recent"))


def attach_recent(captures: DataFrame, actions: DataFrame) -> DataFrame:
    recent = recent_lists(actions).withColumnRenamed("application", "process_name")
    met = captures.join(recent, "process_name", "left")
    return met.withColumn("recent", F.coalesce("recent", F.array().cast("array<string>")))


def history(captures: DataFrame, now: float, hours: float = 24) -> DataFrame:
    """Captures of the last hours before ``now``, newest first; the bound reaches the scan."""
    return captures.filter(F.col("ts_s") > now - hours * 3600).orderBy(F.desc("ts_s"), F.desc("capture_id"))


def classify_actions(actions: DataFrame, key: str = "user_id") -> DataFrame:
    return recent_lists(actions, key).select(key, A.user_activity(F.col("recent")).alias("activity"))


def capability_rows(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.explode(A.capabilities(F.col("process_name"))).alias("capability"))


def activities(captures: DataFrame) -> DataFrame:
    found = captures.withColumn("a", A.detect_activity(F.col("process_name"), F.coalesce("text", F.lit(""))))
    return found.select(*captures.columns, "a.content_type", "a.activity_type")


def analyses(captures: DataFrame) -> DataFrame:
    """The whole analysis of a capture as columns."""
    text = F.coalesce("text", F.lit(""))
    words = T.word_count(text)
    score = A.productivity_score(F.col("activity_type"))
    return activities(captures).select(
        "capture_id", "user_id", "process_name", "content_type", "activity_type", A.time_period(F.col("ts_s")).alias("time_period"),
        words.alias("word_count"), F.length(text).cast("long").alias("char_count"), A.reading_minutes(words).alias("reading_minutes"),
        score.alias("productivity_score"), A.suggestions(score, text).alias("suggestions"),
    )


def analysis_text(captures: DataFrame) -> DataFrame:
    """The analysis as ``Key: value`` lines."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.col(col).cast("string"))
    hints = F.when(F.size("suggestions") > 0, F.concat(F.lit("Suggestions: "), F.array_join("suggestions", ", ")))
    text = F.concat_ws(
        "\n", line("Active Application", "process_name"), line("Content Type", "content_type"), line("Activity Type", "activity_type"),
        line("Time Period", "time_period"), line("Word Count", "word_count"), line("Character Count", "char_count"),
        F.concat(F.lit("Estimated Reading Time: "), F.col("reading_minutes").cast("string"), F.lit(" minutes")),
        F.concat(F.lit("Productivity Score: "), F.col("productivity_score").cast("string"), F.lit("/10")), hints,
    )
    return analyses(captures).select("capture_id", text.alias("analysis"))


KEY_LINES = ("Active Application:", "Activity Type:", "Productivity Score:")


def key_lines(text: Column) -> Column:
    """Struct: the activity read back, and the lines worth keeping."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(KEY_LINES[0])) | F.contains(x, F.lit(KEY_LINES[1])) | F.contains(x, F.lit(KEY_LINES[2])))
    return F.struct(
        T.strip(F.regexp_extract(text, r"(?dm)Activity Type:(.*)$", 1)).alias("activity_type"), F.array_join(kept, "\n").alias("kept")
    )


def session_summary(captures: DataFrame, by: str = "user_id") -> DataFrame:
    """Captures and characters of each session, and its captures by activity."""
    found = activities(captures).select(by, "activity_type", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    each = found.groupBy(by, "activity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    whole = Window.partitionBy(by)
    return each.select(
        by, F.sum("n").over(whole).alias("captures"), F.sum("chars").over(whole).alias("total_chars"), "activity_type", F.col("n").alias("times")
    )


def context_counts(captures: DataFrame) -> DataFrame:
    """Sizes of what a capture holds; parts that it lacks count 0."""
    has = set(captures.columns)
    size = lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) if c in has else F.lit(0)).cast("long")
    from screenloom.functions.web import find_urls

    urls = find_urls(F.col("text"))
    return captures.select(
        "capture_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("text_length"), size("ui_elements").alias("ui_elements"),
        size("file_paths").alias("file_paths"), F.size(urls).cast("long").alias("urls"), (F.size(urls) > 0).alias("web_available"),
    )


def insights(responses: DataFrame) -> DataFrame:
    """Answers worth showing: over 20 characters and without an error."""
    text = F.coalesce("response_text", F.lit(""))
    return responses.filter((F.length(text) > 20) & ~F.contains(F.lower(text), F.lit("error")))
