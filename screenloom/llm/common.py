"""Pieces the training-data operators share: word splitting, shared staging, running sums."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenloom.sources.shared import scratch, staged
from screenloom.sources.tables import read_table

__all__ = ["scratch", "staged"]

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and for blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


#: Bytes of an Arrow batch of whole texts, or one row if that is longer.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within, Arrow batches hold ``n`` rows and ``BATCH_BYTES`` at most; for wide rows that are staged meanwhile."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": n, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in limits}
    for key, limit in limits.items():
        spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        for key, limit in before.items():
            spark.conf.set(key, limit)


def running_sum(df: DataFrame, order: list[Column], value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over all rows before this one in ``order``.

    Range-partitions by the order, sums each range, shifts every range by the sums of the
    ranges before it. Only one row per range ever meets in one task. Tied rows follow each
    other in no stated order, so give a total order where that matters.
    """
    ranged = staged(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), f"ranged-{into}"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    shift = shift.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(shift, "_range")
        .withColumn(into, F.col("_shift") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_shift")
    )


#: Bits of the id filter: a broadcast of at most FILTER_BITS / 64 rows of two numbers.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, col: str = "id") -> DataFrame:
    """A bitmap of hashed ids as rows (slot, bits), of bounded size whatever the number of ids."""
    place = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    spots = ids.select((place / 64).cast("long").alias("slot"), (place % 64).cast("int").alias("bit"))
    bits = spots.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return staged(bits, "id-filter")


def may_be_in(df: DataFrame, col: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose ``col`` may be among the filter's ids; it never drops one that is.

    With very many ids the filter lets all rows pass, which costs time and changes nothing.
    """
    place = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    met = df.withColumn("_place", place).withColumn("slot", (F.col("_place") / 64).cast("long"))
    met = met.join(F.broadcast(bitmap), "slot").filter(F.getbit("bits", (F.col("_place") % 64).cast("int")) == 1)
    return met.drop("_place", "slot", "bits")
