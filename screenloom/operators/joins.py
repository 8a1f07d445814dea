"""Joins across records: as-of context, modalities of one input, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.functions import activity as A
from screenloom.functions.text import word_count
from screenloom.operators.log import recent_lists
from screenloom.operators.ranges import numbered


DAY = 86400


def asof_context(questions: DataFrame, captures: DataFrame, n: int = 1000, span: int = DAY) -> DataFrame:
    """Each question with the start of the user's latest capture at or before it.

    Both tables pass in time order inside spans of a user's time, so a busy user is many tasks;
    what a span begins with is the last capture of the spans before it. No range join.
    """
    cut = lambda d: d.withColumn("span", F.floor(F.col("ts_s") / span))
    none = lambda kind: F.lit(None).cast(kind)
    left = cut(questions).select("user_id", "span", "ts_s", F.lit(1).alias("side"), "question_id", "question", none("string").alias("seen"), F.lit(0).cast("long").alias("cid"))
    right = cut(captures).select(
        "user_id", "span", "ts_s", F.lit(0).alias("side"), none("long").alias("question_id"), none("string").alias("question"),
        F.substring("text", 1, n).alias("seen"), F.col("capture_id").alias("cid"),
    )
    order = Window.partitionBy("user_id", "span").orderBy("ts_s", "side", "cid").rowsBetween(Window.unboundedPreceding, 0)
    met = left.union(right).withColumn("inside", F.last("seen", ignorenulls=True).over(order)).filter("side = 1")
    # one row a user and span: its last capture, handed on to the spans after it
    ends = left.select("user_id", "span", none("string").alias("end")).union(
        right.filter("seen IS NOT NULL").groupBy("user_id", "span").agg(F.max_by("seen", F.struct("ts_s", "cid")).alias("end"))
    )
    ends = ends.groupBy("user_id", "span").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("user_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("user_id", "span", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    met = met.join(carried, ["user_id", "span"], "left").withColumn("context", F.coalesce("inside", "carried"))
    with_text = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.col("question"), F.lit("\n\nOn screen:\n"), F.col("context"))).otherwise(F.col("question"))
    return met.select("question_id", "user_id", "ts_s", "context", with_text.alias("prompt"))


def combine_modalities(inputs: DataFrame, text_analyses: DataFrame | None = None, image_analyses: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """One record an input (a repeated row is an input of its own), with an analysis for each part it has, in order of priority.

    The analyses are tables with a row for each input_id and any other columns; they come as structs
    ``text_analysis``, ``image_analysis`` and ``context_analysis``, null where the input has no such
    part or the table no such row. ``analyses`` counts those found.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    met = inputs.select(
        "input_id", "user_id", "priority", F.when(given("text"), word_count(F.col("text"))).alias("text_words"),
        F.length("scene_description").cast("long").alias("scene_chars"),
        F.when(given("context_process"), A.app_category(F.col("context_process"))).alias("app_type"),
    )
    met = numbered(met, "user_id", ["priority", "input_id"], "place")
    parts = (("text_analysis", text_analyses, "text_words"), ("image_analysis", image_analyses, "scene_chars"), ("context_analysis", contexts, "app_type"))
    for name, table, part in parts:
        if table is None:
            met = met.withColumn(name, F.lit(None).cast("struct<none: string>"))
            continue
        own = table.select(F.col("input_id").alias("_id"), F.struct(*[c for c in table.columns if c != "input_id"]).alias("_found"))
        met = met.join(own, F.col("input_id") == F.col("_id"), "left").withColumn(name, F.when(F.col(part).isNotNull(), F.col("_found"))).drop("_id", "_found")
    count = sum((F.col(name).isNotNull().cast("int") for name, _, _ in parts), F.lit(0))
    return met.select(
        "input_id", "user_id", "priority", "text_words", "scene_chars", "app_type", F.col("text_words").isNotNull().alias("has_text"),
        F.col("scene_chars").isNotNull().alias("has_image"), F.col("app_type").isNotNull().alias("has_context"), (F.col("place") + 1).alias("place"),
        *[name for name, _, _ in parts], count.alias("analyses"),
    )


def topics(inputs: DataFrame, n: int | None = 3) -> DataFrame:
    """A stand-in for extracted topics: the first words of an input's text, or with None all."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    found = found if n is None else F.slice(found, 1, n)
    return inputs.select("user_id", F.posexplode(found).alias("pos", "topic"), "input_id").drop("pos")


def with_next_parts(told: DataFrame, key: str, n: int) -> DataFrame:
    """Key, parts, ahead: the parts with the n that follow them in the key's next descriptions.

    Every description has a part at least, so n descriptions tell the n parts.
    """
    placed = numbered(told, key, ["input_id", "parts"], "place")
    heads = placed.select(
        F.col(key).alias("_key"), F.col("place").alias("_from"), F.slice("parts", 1, n).alias("head"),
        F.explode(F.sequence(F.col("place") - n, F.col("place") - 1)).alias("_place"),
    )
    following = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_from", "head"))), lambda x: x["head"]))
    after = heads.filter("_place >= 0").groupBy("_key", "_place").agg(F.slice(following, 1, n).alias("next"))
    met = placed.join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place")), "left")
    return met.select(key, "parts", F.concat("parts", F.coalesce("next", F.array().cast("array<string>"))).alias("ahead"))


def mentioned(asked: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """The (key, topic) of ``asked`` whose topic stands anywhere in a scene description of its key.

    Descriptions are joined by spaces in the order of their inputs, so a topic of k parts between
    spaces stands in k parts that follow each other there. These windows are taken once a key, and their substrings of the lengths that topics have
    meet the topics by equality: a row is a window or less, and never a key's whole text.
    """
    parts = F.size(F.split("topic", " ", -1))
    shapes = asked.filter(F.col("topic").isNotNull()).select(parts.alias("k"), F.length("topic").alias("len")).distinct()
    told = scenes.filter(F.col("scene_description").isNotNull()).select(key, "input_id", F.split(F.lower("scene_description"), " ", -1).alias("parts"))
    most = shapes.agg(F.max("k")).first()[0] or 1
    told = with_next_parts(told, key, most - 1) if most > 1 else told.withColumn("ahead", F.col("parts"))
    met = told.join(F.broadcast(shapes.select("k").distinct()), F.size("ahead") >= F.col("k"))
    window = lambda i: F.array_join(F.slice("ahead", i, F.col("k")), " ")
    starts = F.sequence(F.lit(1), F.least(F.size("parts"), F.size("ahead") - F.col("k") + 1))
    windows = met.select(key, "k", F.explode(F.array_distinct(F.transform(starts, window))).alias("w")).distinct()
    met = windows.join(F.broadcast(shapes), "k").filter(F.length("w") >= F.col("len"))
    starts = F.sequence(F.lit(1), F.length("w") - F.col("len") + 1)
    found = met.select(key, F.explode(F.transform(starts, lambda i: F.substring("w", i, F.col("len")))).alias("topic"))
    return asked.select(key, "topic").join(found, [key, "topic"], "left_semi")


def alignment(topic_rows: DataFrame, scenes: DataFrame, key: str = "user_id") -> DataFrame:
    """Share of a request's topics that its scene descriptions mention; 0 without either."""
    asked = topic_rows.groupBy(key, F.lower("topic").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    seen = mentioned(asked, scenes, key).withColumn("seen", F.lit(True))
    counted = asked.join(seen, [key, "topic"], "left").groupBy(key).agg(F.sum(F.when(F.col("seen"), F.col("n"))).alias("hits"), F.sum("n").alias("topics"))
    total = scenes.select(key).distinct().join(counted, key, "left").withColumn("topics", F.coalesce("topics", F.lit(0)))
    share = F.when(F.col("topics") > 0, F.coalesce("hits", F.lit(0)) / F.col("topics")).otherwise(F.lit(0.0))
    return total.select(key, "topics", F.round(share, 6).alias("alignment"))


def context_insights(captures: DataFrame, actions: DataFrame) -> DataFrame:
    """What is known of the application, and of its recent actions where there are any."""
    met = captures.join(recent_lists(actions).withColumnRenamed("application", "process_name"), "process_name", "left")
    process, has = F.col("process_name"), F.col("process_name").isNotNull()
    application = F.when(has, F.struct(
        A.app_category(process).alias("app_type"), A.usage_intensity(F.col("cpu_percent"), F.col("memory_usage")).alias("usage_intensity"),
        A.capabilities(process).alias("capabilities"),
    ))
    behaviour = F.when(F.col("recent").isNotNull(), A.user_activity(F.col("recent")))
    return met.select("capture_id", application.alias("application"), behaviour.alias("behaviour"))
