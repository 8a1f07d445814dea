"""Append-only logs and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def action_rows(actions: DataFrame) -> DataFrame:
    """Rows for the action log; absent metadata is an empty JSON object."""
    return actions.select(
        "id", F.col("ts_s").cast("double").alias("timestamp"), "action_type", "application", "description",
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )


def log_actions(actions: DataFrame, path: str) -> None:
    """Append to the action log, a folder for each day so that time ranges prune."""
    rows = action_rows(actions).withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))
    rows.write.mode("append").partitionBy("day").parquet(path)


def context_rows(captures: DataFrame) -> DataFrame:
    """Rows for the context log: a summary, labelled parts in one text, and JSON metadata.

    Parts that a capture lacks may be given as columns hidden_text, ui_elements, file_paths,
    urls and recent_actions.
    """
    has = set(captures.columns)
    part = lambda name, empty: F.coalesce(F.col(name), empty) if name in has else empty
    none = F.array().cast("array<string>")
    listed = lambda name: F.array_join(part(name, none), ", ")
    ui = F.coalesce(F.to_json("ui_elements"), F.lit("[]")) if "ui_elements" in has else F.lit("[]")
    full = F.concat_ws(
        "\n",
        F.concat(F.lit("Visible Text: "), part("text", F.lit(""))),
        F.concat(F.lit("Hidden Text: "), part("hidden_text", F.lit(""))),
        F.concat(F.lit("UI Elements: "), ui),
        F.concat(F.lit("File Paths: "), listed("file_paths")),
        F.concat(F.lit("URLs: "), listed("urls")),
        F.concat(F.lit("Recent Actions: "), listed("recent_actions")),
    )
    return captures.select(
        "capture_id", F.col("ts_s").cast("double").alias("timestamp"), "process_name", "window_title",
        F.substring(part("text", F.lit("")), 1, 500).alias("content_summary"), full.alias("full_content"),
        F.to_json(F.struct("memory_usage", "cpu_percent")).alias("metadata"),
    )


def store_contexts(captures: DataFrame, path: str) -> None:
    """Append to the context log."""
    context_rows(captures).write.mode("append").parquet(path)


def write_texts(lines: DataFrame, path: str, key: str, *order: str, line: str = "line") -> None:
    """Lines as text, a folder for each key; its files, in the order of their names, hold its lines in order.

    Lines are range-partitioned by key and place, so a text of any size is written by many tasks.
    Line ends inside a line would make two lines of it: they become spaces.
    """
    ordered = lines.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    value = F.regexp_replace(F.coalesce(line, F.lit("")), "[\r\n]", " ").alias("value")
    ordered.select(F.col(key).alias("key"), value).write.mode("overwrite").partitionBy("key").text(path)


def write_report(lines: DataFrame, path: str, key: str = "conv_id") -> None:
    """Report lines as text files, a folder for each session."""
    write_texts(lines, path, key, "idx", "line_no")
