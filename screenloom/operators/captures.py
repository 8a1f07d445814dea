"""Ordered captures of a session: change, stop rules, merged lines, search in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenloom.functions.text import strip
from screenloom.operators.ranges import numbered

SAME, CHANGED, MAX_FRAMES = 0.95, 0.8, 20


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of equal length; 0 where it is not defined."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = lambda a: total(F.transform(a, lambda v: v.cast("double"))) / F.size(a)
    mx, my = mean(x), mean(y)
    moments = F.aggregate(
        F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))),
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), mx.alias("mx"), my.alias("my")),
        lambda s, p: F.struct(
            (s["xy"] + (p["a"] - s["mx"]) * (p["b"] - s["my"])).alias("xy"),
            (s["xx"] + (p["a"] - s["mx"]) * (p["a"] - s["mx"])).alias("xx"),
            (s["yy"] + (p["b"] - s["my"]) * (p["b"] - s["my"])).alias("yy"),
            s["mx"].alias("mx"), s["my"].alias("my"),
        ),
        lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(F.lit(0.0)),
    )
    return F.coalesce(F.when(F.size(x) == F.size(y), moments), F.lit(0.0))


def similarity_to_previous(frames: DataFrame) -> DataFrame:
    """Similarity of each frame to the one before it in its session; the first has 0."""
    order = Window.partitionBy("seq_id").orderBy("position")
    met = frames.withColumn("before", F.lag("vec").over(order))
    return met.select("seq_id", "position", F.round(correlation(F.col("vec"), F.col("before")), 6).alias("similarity"))


def until_first(rows: DataFrame, stop: Column, key: str, order: list[str]) -> DataFrame:
    """Rows of each key up to and including the first where ``stop`` holds.

    The first stop of a key is a grouped minimum, combined before the shuffle, so a large key is
    never sorted in one task.
    """
    first = rows.filter(stop).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    met = rows.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.filter(F.col("_first").isNull() | (F.struct(*order) <= F.col("_first"))).select(*rows.columns)


def until_stop(frames: DataFrame, threshold: float = SAME, most: int = MAX_FRAMES) -> DataFrame:
    """Frames up to the first that repeats its predecessor, and no more than ``most``."""
    scored = similarity_to_previous(frames)
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("position"))
    stop = (F.col("similarity") > threshold) & (F.col("place") > 1)
    return until_first(scored.withColumn("place", place).filter(F.col("place") <= most), stop, "seq_id", ["position"]).drop("place")


def until_text(captures: DataFrame, target: str, key: str = "source", order: str = "capture_id") -> DataFrame:
    """Captures up to the first that has the target, in any case."""
    stop = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(target.lower()))
    return until_first(captures, stop, key, [order])


def structure(frames: DataFrame) -> DataFrame:
    """Frames, changes, repeats and the share of changes of each session."""
    scored = similarity_to_previous(frames)
    later = F.row_number().over(Window.partitionBy("seq_id").orderBy("position")) > 1
    scored = scored.withColumn("later", later)
    grouped = scored.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("later") & (F.col("similarity") < CHANGED)).alias("changes"),
        F.count_if(F.col("later") & (F.col("similarity") > SAME)).alias("duplicates"),
    )
    share = F.when(F.col("total") > 1, F.col("changes") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return grouped.withColumn("efficiency", F.round(share, 6))


def frame_confidence(frames: DataFrame) -> DataFrame:
    scored = similarity_to_previous(frames)
    return scored.select(
        "seq_id", "position", F.round(1 - F.col("similarity"), 6).alias("confidence"), F.concat(F.lit("frame "), F.col("position").cast("string")).alias("label")
    )


def first_sights(captures: DataFrame, key: str, order: str) -> DataFrame:
    """Key, line, _at, _no: each distinct line of a session once, with the place where it is first seen.

    The first sight is a grouped minimum, so a line that repeats everywhere is combined before
    it is shuffled.
    """
    lines = captures.select(key, order, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    lines = lines.select(key, order, "line_no", strip(F.col("raw")).alias("line")).filter(F.col("line") != "")
    first = lines.groupBy(key, "line").agg(F.min(F.struct(order, "line_no")).alias("at"))
    return first.select(key, "line", F.col(f"at.{order}").alias("_at"), F.col("at.line_no").alias("_no"))


def merged_lines(captures: DataFrame, key: str = "source", order: str = "capture_id") -> DataFrame:
    """Key, line_idx, line: each distinct line of a session once, numbered in ranges."""
    return numbered(first_sights(captures, key, order), key, ["_at", "_no"], "line_idx").select(key, "line_idx", "line")


def merged_text(captures: DataFrame, key: str = "source", order: str = "capture_id") -> DataFrame:
    """The merged lines of each session as one text; use ``merged_lines`` for very long sessions."""
    lines = merged_lines(captures, key, order)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(joined.alias("merged"))


SCROLLED = "\n--- scrolled content ---\n"
#: No Spark string or array holds more bytes.
MOST_BYTES = 2**31 - 2**20
#: A text is held so many times over, as rows, array and string, while it is made.
COPIES = 8


def largest_text(spark: SparkSession) -> int:
    """Bytes of a text that a task can make in its share of an executor's memory."""
    conf = spark.sparkContext.getConf()
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        memory, cores = spark._jvm.java.lang.Runtime.getRuntime().maxMemory(), spark.sparkContext.defaultParallelism
    else:
        memory = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
        cores = int(conf.get("spark.executor.cores", "1"))
    return min(MOST_BYTES, memory // (COPIES * max(1, cores)))


def combined_lines(captures: DataFrame, key: str = "source", order: str = "capture_id") -> DataFrame:
    """Key, position, line: the first capture's lines, a marker, and what the session adds to it.

    Lines of any session are numbered in ranges, so no task holds a session.
    """
    added = first_sights(captures, key, order)
    at = added.schema["_at"].dataType
    row = lambda d, part, no, line: d.select(key, F.lit(part).alias("_part"), F.lit(None).cast(at).alias("_at"), no.alias("_no"), line.alias("line"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    first = captures.groupBy(key).agg(F.min_by(F.coalesce("text", F.lit("")), order).alias("text"))
    visible = row(first.select(key, F.posexplode(lines).alias("no", "x")), 0, F.col("no"), F.col("x"))
    adds = captures.filter(F.exists(lines, lambda x: strip(x) != "")).select(key).distinct()
    marker = row(adds, 1, F.lit(0), F.lit(SCROLLED.strip("\n")))
    rows = visible.union(marker).union(added.select(key, F.lit(2).alias("_part"), "_at", "_no", "line"))
    return numbered(rows, key, ["_part", "_at", "_no"], "position").select(key, "position", "line")


def combined_text(captures: DataFrame, key: str = "source", order: str = "capture_id", most: int | None = None) -> DataFrame:
    """The combined lines of each session as one text.

    One task makes one text, so none may have over ``most`` bytes, by default what a task's share of
    memory can make: sizes are summed first, and longer sessions are refused by name.
    ``combined_lines`` takes sessions of any size, and ``sinks.write_texts`` writes them as text.
    """
    most = largest_text(captures.sparkSession) if most is None else most
    lines = combined_lines(captures, key, order)
    size = F.sum(F.octet_length("line") + F.lit(1).cast("long"))
    long = lines.groupBy(key).agg(size.alias("size")).filter(F.col("size") > most).orderBy(F.desc("size")).limit(5).collect()
    if long:
        told = ", ".join(f"{r[key]} ({r['size']} bytes)" for r in long)
        raise ValueError(f"sessions too long for one string of {most} bytes, take combined_lines: {told}")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(joined.alias("combined"))


def search_lines(captures: DataFrame, term: str, stop_at_hit: bool = True, key: str = "source", order: str = "capture_id") -> DataFrame:
    """Merged lines with the term: index, line, and the two lines on either side.

    With ``stop_at_hit`` captures after the first with the term are never seen.
    """
    rows = until_text(captures, term, key, order) if stop_at_hit else captures
    lines = merged_lines(rows, key, order)
    hits = lines.filter(F.contains(F.lower("line"), F.lit(term.lower())))
    # each hit asks for the lines around it by their index
    wanted = hits.select(F.col(key).alias("_key"), F.col("line_idx").alias("_hit"), F.explode(F.sequence(F.col("line_idx") - 2, F.col("line_idx") + 2)).alias("_idx"))
    near = lines.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("line_idx") == F.col("_idx")))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_idx", "line"))), lambda x: x["line"]), "\n")
    middle = F.max(F.when(F.col("_idx") == F.col("_hit"), F.col("line")))
    found = near.groupBy(key, F.col("_hit").alias("line_idx")).agg(middle.alias("line"), told.alias("context"))
    return found.select(key, "line_idx", "line", "context")


NOT_FOUND = "not found"


def search_contexts(captures: DataFrame, term: str, hits: int = 3, key: str = "source", order: str = "capture_id") -> DataFrame:
    """The contexts of the first hits of every session, or a note that there are none."""
    found = search_lines(captures, term, True, key, order)
    place = F.row_number().over(Window.partitionBy(key).orderBy("line_idx"))
    found = found.withColumn("n", place).filter(F.col("n") <= hits)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "context"))), lambda x: x["context"]), "\n")
    met = captures.select(key).distinct().join(found.groupBy(key).agg(joined.alias("context")), key, "left")
    return met.select(key, F.coalesce("context", F.lit(NOT_FOUND)).alias("context"))
