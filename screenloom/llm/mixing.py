"""Mixing sources to target weights without a global sort.

Every document gets a hash-random key; within its source documents are range-sorted by key;
distributed prefix sums of sizes tell where each source's budget is used up. A budget above
the source's size repeats the source for whole epochs before the cut.

Defined cases: a null text has size 0; the null source comes last among sources; sources of
size 0 get target 0; an empty table gives an empty result; repeated rows are documents of
their own, counted together until each gets its part; rows that share an id, or have none, are
told apart by their texts; texts of any length are taken whole; other columns of the input are
not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm.common import n_words, running_sum, scratch, staged

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Hex digits of the key that name a range: 16**3 ranges a source, as keys are uniform.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, total_share: float = 1.0) -> DataFrame:
    """source, source_size, target: weights by code-point order, capped at 3 source sizes.

    Reshared excess settles at target = min(cap, weight * level); the level is found among
    sources in the order in which they would reach their caps.
    """
    by_source = staged(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")),
        "mix-sources",
    )
    ranked = running_sum(by_source, [F.col("source").asc_nulls_last()], "one", "place").drop("one")
    nth = (F.col("place") % len(WEIGHTS)).cast("int")
    weighed = ranked.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), nth + 1).alias("weight"),
        (F.col("source_size") * MAX_REPEATS).cast("double").alias("cap"),
    )
    weighed = weighed.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = [F.col("full_at").asc(), F.col("source").asc_nulls_last()]
    summed = staged(running_sum(running_sum(weighed, order, "cap", "cap_before"), order, "weight", "weight_before"), "mix-caps")
    totals = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight")).first()
    total, all_weight = float(totals.total or 0) * total_share, float(totals.all_weight or 0)
    level_at = (F.lit(total) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    # the first source that the level doesn't fill
    level = (
        summed.withColumn("level", level_at)
        .filter(F.col("level") <= F.col("full_at"))
        .agg(F.min_by("level", F.struct("full_at", "cap_before")).alias("level"))
        .first()
    ).level
    return summed.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level or 0.0)).alias("target"))


def random_key(id_col: Column, text: Column, seed: str) -> Column:
    """Of id and text, so that rows of one id, or without any, spread over the ranges too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, and the carried columns; staged."""
    with scratch(docs.sparkSession) as keep:
        return keep(placed_rows(docs, text, source, id_col, seed, carry), "mix")


def placed_rows(docs: DataFrame, text: str, source: str, id_col: str, seed: str, carry: tuple[str, ...]) -> DataFrame:
    """The same, not staged."""
    each = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("own_size"),
        random_key(F.col(id_col), F.col(text), seed).alias("key"), *carry,
    )
    # rows alike in all are one row with a count, so that no key is larger than a row
    alike = each.groupBy("doc_id", "source", "own_size", "key", *carry).agg(F.count(F.lit(1)).alias("copies"))
    alike = alike.withColumn("size", F.col("own_size") * F.col("copies")).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sizes = staged(alike, "mix-sizes")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("size"))
    ranges = ranges.select(
        F.col("source").alias("r_source"), F.col("range").alias("r_range"),
        before(Window.partitionBy("source").orderBy("range")).alias("range_before"),
    )
    # targets meet the ranges (at most 16**3 a source), never the documents of a hot source
    targets = source_targets(sizes)
    ranges = ranges.join(targets, F.col("r_source").eqNullSafe(F.col("source"))).drop("source")
    inside = sizes.withColumn(
        "inside_before", before(Window.partitionBy("source", "range").orderBy("key", "doc_id", "own_size", *carry))
    )
    placed = inside.join(
        ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))
    ).drop("r_source", "r_range")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start, size = F.col("range_before") + F.col("inside_before") + F.col("copy") * F.col("own_size"), F.col("own_size")
    taken = epochs * size + F.least(size, F.greatest(F.lit(0), rest - start))
    return placed.select("doc_id", size.alias("size"), "source", "source_size", "target", taken.cast("long").alias("taken"), *carry)
