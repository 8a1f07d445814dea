"""Numbers and neighbours inside keys of any size, without a task that holds a whole key.

Rows are range-partitioned by key and order, so a large key spreads over many ranges; each range
is worked on by itself, and meets one row of what the key's other ranges hold. The ranges are
written once, as all steps must see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.sources.shared import staged

#: What ``stitched`` can add, and from which summary of a range.
PLACE, COUNT, PREVIOUS, NEXT, LAST_BEFORE, FIRST_FROM = "place", "count", "previous", "next", "last before", "first from"


def stitched(rows: DataFrame, key: str, order: list[str | Column], **made: tuple[str, str | None]) -> DataFrame:
    """Add columns, each of a kind and made from a column, inside each key in the given order.

    ``PLACE`` 0, 1, 2...; ``COUNT`` the key's rows; ``PREVIOUS`` and ``NEXT`` a column in the row before and
    after; ``LAST_BEFORE`` its last value that is not null, in the rows before; ``FIRST_FROM`` its first that is
    not null, from this row on. A null key is a key of its own.
    """
    ranged = staged(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(key, "_range").orderBy(*order)
    place = ranged.withColumn("_place", F.row_number().over(own) - 1)
    sums, carried, columns = [F.count(F.lit(1)).alias("_n")], [], []
    of_key = Window.partitionBy("_key").orderBy("_r")
    before, after = of_key.rowsBetween(Window.unboundedPreceding, -1), of_key.rowsBetween(1, Window.unboundedFollowing)
    for name, (kind, column) in made.items():
        value, end = None if column is None else F.struct(F.col(column).alias("v")), f"_end_{name}"
        if kind == PLACE:
            carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(end))
            columns.append((F.col(end) + F.col("_place")).cast("long").alias(name))
        elif kind == COUNT:
            carried.append(F.sum("_n").over(Window.partitionBy("_key")).alias(end))
            columns.append(F.col(end).cast("long").alias(name))
        elif kind in (PREVIOUS, NEXT):
            # a struct tells a null in the row beside from no row beside
            sums.append((F.max_by if kind == PREVIOUS else F.min_by)(value, "_place").alias(end))
            carried.append((F.lag if kind == PREVIOUS else F.lead)(end).over(of_key).alias(end))
            beside = (F.lag if kind == PREVIOUS else F.lead)(value).over(own)
            columns.append(F.coalesce(beside, F.col(end))["v"].alias(name))
        else:
            held, back = F.when(F.col(column).isNotNull(), F.col("_place")), kind == LAST_BEFORE
            sums.append((F.max_by if back else F.min_by)(value, held).alias(end))
            carried.append((F.last(end, True).over(before) if back else F.first(end, True).over(after)).alias(end))
            near = own.rowsBetween(Window.unboundedPreceding, -1) if back else own.rowsBetween(0, Window.unboundedFollowing)
            beside = (F.last if back else F.first)(F.when(F.col(column).isNotNull(), value), True).over(near)
            columns.append(F.coalesce(beside, F.col(end))["v"].alias(name))
    ends = place.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(*sums).select("_key", "_r", *carried)
    met = place.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return met.select(*rows.columns, *columns)


def numbered(rows: DataFrame, key: str, order: list[str | Column], into: str) -> DataFrame:
    """Add ``into``: 0, 1, 2... in the given order inside each key."""
    return stitched(rows, key, order, **{into: (PLACE, None)})
