"""Line dedup: lines that several documents hold are dropped from all of them but one.

Every text is split into lines; a line's key is the line without surrounding blanks, A-Z in
lower case. Keys are hashed to 128 bits and exploded, the distinct documents of every hash are
counted, and the lines of keys in too many documents are dropped by position; the rest is put
together again in order. Counts are combined before they are shuffled, and a text moves once, to
meet the positions that it loses; the lines of a hot key are split by the engine's skew join.

Defined cases: a null or empty text is one empty line; a document is an id, so rows that repeat
an id, and rows without id, count once for a key; no id is smaller than any id, and of several
rows with the largest id all keep the line; an empty table gives an empty result; texts and lines
of any length are taken whole; other columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, scratch, staged

#: A key shorter than this is never dropped; one in at least so many documents is.
MIN_LENGTH, MIN_DOCS = 20, 3
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of an Arrow batch of texts.
BATCH = 1024


def row_marks(id_col: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text; rows that agree in both share their fate."""
    return [F.xxhash64(id_col, text).alias("mark"), F.xxhash64(text, id_col).alias("mark2")]


def line_keys(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    """(mark, mark2, id, text) to a row for every line with a key long enough: mark, mark2, id, line, h1, h2."""
    for batch in batches:
        rows, places, digests = [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            for i, line in enumerate((text or "").encode("utf-8", "replace").translate(LOWER).split(b"\n")):
                key = line.strip(BLANKS)
                # a code point has one byte that is no continuation
                if len(key) >= min_length and (key.isascii() or sum(1 for b in key if b & 0xC0 != 0x80) >= min_length):
                    rows.append(r)
                    places.append(i)
                    digests.append(xxhash.xxh3_128_digest(key))
        two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        columns = [batch.column(c).take(at) for c in ("mark", "mark2", "id")]
        columns += [pa.array(places, pa.int32()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(columns, ["mark", "mark2", "id", "line", "h1", "h2"])


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, last: the hashes that at least ``min_docs`` documents hold, and the largest id among these."""
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return lines.groupBy("h1", "h2").agg(n.alias("docs"), F.max("id").alias("last")).filter(F.col("docs") >= min_docs).drop("docs")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, kept_text; staged."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
        marked = own.select(*row_marks(F.col("id"), F.col("text")), "id", "text")
        schema = f"mark long, mark2 long, id {own.schema['id'].dataType.simpleString()}, line int, h1 long, h2 long"
        with arrow_rows(spark, BATCH):
            lines = staged(marked.mapInArrow(lambda batches: line_keys(batches, min_length), schema), "line-keys")
        common = staged(common_keys(lines, min_docs), "common-keys").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "last")
        met = lines.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))).filter(~F.col("id").eqNullSafe(F.col("last")))
        # a set, so that copies of a row under one id don't add up
        gone = met.groupBy("mark", "mark2").agg(F.collect_set("line").alias("gone"))
        gone = gone.select(F.col("mark").alias("g1"), F.col("mark2").alias("g2"), "gone")
        return keep(reassembled(marked.join(gone, (F.col("mark") == F.col("g1")) & (F.col("mark2") == F.col("g2")), "left")), "line-dedup")


def reassembled(rows: DataFrame) -> DataFrame:
    """(id, text, gone) to doc_id, n_lines, n_dropped, kept_text: the lines at other positions, in order."""
    whole = F.coalesce("text", F.lit(""))
    n_lines = F.regexp_count(whole, F.lit("\n")) + 1
    rows = rows.select("id", whole.alias("whole"), n_lines.alias("n"), "gone")
    lines = F.split("whole", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    rows = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), lines)).withColumn("left", F.when(F.col("gone").isNotNull(), left))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(kept).alias("kept_text"),
    )
