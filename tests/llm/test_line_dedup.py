"""Line dedup against a plain rendering of its rule, on hard rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from screenloom.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, mark int, gone string, line int, h1 string, last int"
LONG = "A line that Several documents hold"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], SCHEMA)


def plain(rows, min_length=20, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_length:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            h = holders[key(line)] if len(key(line)) >= min_length else ()
            last = max((x for x in h if x is not None), default=None)
            if len(h) < min_docs or d == last:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def test_hard_rows(spark):
    rows = [
        (1, f"{LONG}\nown one\n\n  {LONG.upper()}\r\n"), (2, f"\t{LONG} \x0b"), (3, f"first\n{LONG}"), (4, None), (5, ""), (6, "\n"),
        (7, "É" + "x" * 19 + "\n" + "y" * 19), (8, "é" + "x" * 19 + "\n" + "y" * 19), (9, "É" + "X" * 19 + "\n" + "Y" * 19), (10, "É" + "x" * 19),
        (11, " " + LONG), (12, " ".join([LONG] * 3)), (None, LONG), (None, LONG + "\nno id here, never an id at all"), (None, "no id here, never an id at all"),
        (3, f"first\n{LONG}"), (3, LONG), (2, "another text of the id two\n" + LONG),
    ] + [(20, "no id here, never an id at all"), (21, "w " * 200_000 + "\n" + "a line in one document only, twice\n" * 2)]
    assert got(line_dedup.dedup_lines(table(spark, rows))) == plain(rows)
    few = line_dedup.dedup_lines(table(spark, rows), min_length=5, min_docs=2)
    assert got(few) == plain(rows, 5, 2)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_a_line_of_every_document_and_copies_without_id(spark):
    """A third of all rows are one text without id: what they lose is one text's lines, not all copies'."""
    rows = [(i, f"own line number {i} of its own\n{LONG}\nend {i}") for i in range(400)] + [(None, f"{LONG}\nlast")] * 200
    found = got(line_dedup.dedup_lines(table(spark, rows)))
    assert found == plain(rows) and sum(r[2] for r in found) == 399 + 200


def test_counts_are_combined_before_they_are_shuffled(spark):
    lines = spark.range(1000).select(F.col("id"), F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"))
    plan = line_dedup.common_keys(lines, 3)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert [tuple(r) for r in line_dedup.common_keys(lines, 3).collect()] == [(1, 2, 999)]
