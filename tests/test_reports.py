"""Reports and combined texts as files, read back."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from screenloom.operators import answers, captures
from screenloom.sources import sinks
from screenloom.sources.shared import fresh_dir
from screenloom.sources.tables import view


def read_back(path, key):
    """The lines of a key's files, in the order of their names."""
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/key={key}/part-*"))
    return [line.rstrip("\n") for f in files for line in open(f, encoding="utf-8")]  # noqa: SIM115


def test_a_report_is_written_whole_and_in_order(spark, sf):
    lines = answers.report_lines(view(spark, sf, "responses"), notes=view(spark, sf, "notes"), last=None)
    path = fresh_dir(spark, "report")
    sinks.write_report(lines, path)
    want = {}
    for r in lines.orderBy("conv_id", "idx", "line_no").collect():
        want.setdefault(r.conv_id, []).append(r.line)
    assert len(want) > 3 and want[-5] == ["User Notes", "notes alone"]
    for key, told in want.items():
        assert read_back(path, key) == told


def test_one_session_of_any_size_is_many_files(spark):
    rows = spark.range(40_000).select(F.lit("s").alias("source"), F.col("id").alias("capture_id"), F.concat(F.lit("line "), F.col("id")).alias("text"))
    path = fresh_dir(spark, "combined")
    lines = captures.combined_lines(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_texts(lines, path, "source", "position")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{path.removeprefix('file://')}/key=s/part-*")) > 1
    assert read_back(path, "s") == ["line 0", "--- scrolled content ---", *[f"line {i}" for i in range(40_000)]]


def test_notes(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b\nc"), (2, 0, "d")], "conv_id int, turn int, response_text string")
    notes = spark.createDataFrame([(1, "\n n1\nn2 €\n"), (2, " \n"), (3, "x"), (4, None)], "conv_id int, notes string")
    got = [tuple(r) for r in answers.report_lines(rows, notes=notes, last=1).orderBy("conv_id", "idx", "line_no").collect()]
    assert got == [(1, 1, 0, "Response 1:"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 2, 0, "User Notes"), (1, 2, 1, "n1"), (1, 2, 2, "n2 ?"), (2, 1, 0, "Response 1:"), (2, 1, 1, "d"), (3, 1, 0, "User Notes"), (3, 1, 1, "x")]


def test_the_context_log_is_appended_to(spark, sf):
    rows, path = view(spark, sf, "captures"), fresh_dir(spark, "contexts")
    sinks.store_contexts(rows.limit(20), path)
    sinks.store_contexts(rows.limit(20), path)
    assert spark.read.parquet(path).count() == 40 and os.listdir(path.removeprefix("file://"))


def test_texts_beyond_a_tasks_memory_are_refused_by_name(spark):
    rows = spark.createDataFrame([("long", 1, "x" * 500 + "\n" + "y" * 500), ("short", 2, "z")], "source string, capture_id int, text string")
    with pytest.raises(ValueError, match="long"):
        captures.combined_text(rows, most=900)
    assert captures.combined_text(rows).count() == 2 and 0 < captures.largest_text(spark) < captures.MOST_BYTES
