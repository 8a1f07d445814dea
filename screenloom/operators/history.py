"""Bounded histories and rules that depend on what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.operators.ranges import COUNT, FIRST_FROM, LAST_BEFORE, NEXT, PLACE, PREVIOUS, numbered, stitched
from screenloom.sources.shared import scratch, staged

ORDER = ("ts_s", "id")


def in_order(key: str, order: tuple[str, ...]) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def last_n(rows: DataFrame, key: str, n: int = 50, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last n rows of every key."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")


def bounded(rows: DataFrame, key: str, most: int = 20, keep: int = 15, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What is left when a list that outgrows ``most`` is cut to its last ``keep``.

    After n appends that is n rows up to ``most``, then it cycles from ``keep`` upwards.
    """
    n = F.count(F.lit(1))
    left = F.when(n <= most, n).otherwise(keep + F.pmod(n - (most + 1), F.lit(most + 1 - keep)))
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(left.alias("_left"))
    # only the newest ``most`` rows of a key leave a task; sizes are combined before the shuffle
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    met = rows.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= most)
    met = met.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    return met.filter(F.col("_n") <= F.col("_left")).select(*rows.columns)


def every_2nd(rows: DataFrame, key: str, most: int = 20, keep: int = 15, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows at whose arrival the list of ``bounded``, before its cut, has an even size."""
    n = F.col("_n") + 1
    size = F.when(n <= most + 1, n).otherwise(keep + 1 + F.pmod(n - (most + 2), F.lit(most + 1 - keep)))
    met = numbered(rows, key, list(order), "_n").withColumn("size_before_cut", size.cast("long"))
    return met.filter("size_before_cut % 2 = 0").drop("_n")


def reached(jumps: DataFrame) -> DataFrame:
    """Of nodes (k, t, jump) those that a key's first node reaches by jumps, itself included.

    Doubling: the nodes that 2**i jumps lead to from those reached by fewer are added, then jumps
    are put end to end; so there are as many rounds as the longest way has binary digits.
    """
    found = jumps.groupBy("k").agg(F.min("t").alias("t"))
    jumps, left = staged(jumps.filter("jump IS NOT NULL"), "jumps", {"n": F.count(F.lit(1))})
    while left["n"]:
        on = jumps.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("jump").alias("jump2"))
        same = lambda d, at: d.join(on, F.col("k").eqNullSafe(F.col("k2")) & (F.col(at) == F.col("t2")))
        found = staged(found.union(same(found, "t").select("k", F.col("jump2").alias("t"))), "reached")
        jumps, left = staged(same(jumps, "jump").select("k", "t", F.col("jump2").alias("jump")), "jumps", {"n": F.count(F.lit(1))})
    return found


#: Keys of up to so many questions are folded in one go; larger ones are worked on in ranges.
FEW = 256


def cooldown(questions: DataFrame, seconds: float, key: str = "user_id", few: int = FEW) -> DataFrame:
    """question_id, key, ts_s, status, remaining: at most one accepted question in ``seconds``.

    A question without a time is ignored; one without an id comes first among those of its time.
    """
    with scratch(questions.sparkSession) as keep:
        rows = questions.select(F.col(key).alias("k"), "ts_s", "question_id", (F.trim(F.coalesce("question", F.lit(""))) == "").alias("empty"))
        sizes = rows.groupBy(F.col("k").alias("k1")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("k1")
        large, seen = staged(sizes, "large", {"n": F.count(F.lit(1))})
        if seen["n"]:
            same = F.col("k").eqNullSafe(F.col("k1"))
            told = folded(rows.join(large, same, "left_anti"), seconds).union(jumped(rows.join(large, same, "left_semi"), seconds))
        else:
            told = folded(rows, seconds)
        return keep(told.select("question_id", F.col("k").alias(key), "ts_s", "status", "remaining"), "cooldown")


def folded(rows: DataFrame, seconds: float) -> DataFrame:
    """The rule over the sorted questions of each key, one after the other; for keys of few."""
    met = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("ts_s", "question_id", "empty"))).alias("rows"))
    kind = "struct<last: bigint, told: array<struct<question_id: bigint, ts_s: bigint, status: string, remaining: bigint>>>"

    def step(at: Column, q: Column) -> Column:
        wait = at["last"].isNotNull() & F.coalesce(q["ts_s"] - at["last"] < seconds, F.lit(False))
        status = F.when(wait, "wait").when(q["empty"] | q["ts_s"].isNull(), "ignored").otherwise("accepted")
        left = F.when(wait, F.floor(seconds - (q["ts_s"] - at["last"]))).otherwise(F.lit(0)).cast("long")
        row = F.struct(q["question_id"].alias("question_id"), q["ts_s"].alias("ts_s"), status.alias("status"), left.alias("remaining"))
        return F.struct(F.when(status == "accepted", q["ts_s"]).otherwise(at["last"]).alias("last"), F.concat(at["told"], F.array(row)).alias("told")).cast(kind)

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().alias("told")).cast(kind)
    return met.select("k", F.explode(F.aggregate("rows", start, step, lambda at: at["told"])).alias("q")).select("k", "q.*")


def jumped(rows: DataFrame, seconds: float) -> DataFrame:
    """The rule for keys of any size.

    What is accepted next follows from a question's time alone: the key's first question with text
    that comes at least ``seconds`` later. The accepted ones are those that the key's first
    reaches by such jumps. All steps work in ranges, so a key with all rows is many tasks.
    """
    rows = staged(rows, "questions")
    nodes = rows.filter("NOT empty AND ts_s IS NOT NULL").select("k", F.col("ts_s").alias("t")).distinct()
    # each time also asks what comes at or after it and the pause
    asked = nodes.select("k", (F.col("t") + seconds).cast("double").alias("at"), "t", F.lit(None).cast("long").alias("node"))
    met = asked.union(nodes.select("k", F.col("t").cast("double"), "t", F.col("t").alias("node")))
    met = stitched(met, "k", ["at", F.col("node").isNotNull(), "t"], jump=(FIRST_FROM, "node"))
    accepted = reached(met.filter("node IS NULL").select("k", "t", "jump")).select(F.col("k").alias("k2"), "t")
    first = rows.filter("NOT empty").groupBy("k", "ts_s").agg(F.min(F.struct("question_id")).alias("first"))
    first = first.join(accepted, (F.col("ts_s") == F.col("t")) & F.col("k").eqNullSafe(F.col("k2"))).select(F.col("k").alias("k1"), "t", "first")
    taken = ~F.col("empty") & F.col("first").eqNullSafe(F.struct("question_id"))
    marked = rows.join(first, F.col("k").eqNullSafe(F.col("k1")) & (F.col("ts_s") == F.col("t")), "left").withColumn("took", F.when(taken, F.col("t")))
    # a repeated row waits for itself
    told = stitched(marked, "k", ["ts_s", "question_id", F.col("took").isNull()], last=(LAST_BEFORE, "took"))
    wait = F.col("last").isNotNull() & F.coalesce(F.col("ts_s") - F.col("last") < seconds, F.lit(False))
    return told.select(
        "k", "question_id", "ts_s", F.when(wait, "wait").when(F.col("empty") | F.col("ts_s").isNull(), "ignored").otherwise("accepted").alias("status"),
        F.when(wait, F.floor(seconds - (F.col("ts_s") - F.col("last")))).otherwise(F.lit(0)).cast("long").alias("remaining"),
    )


def nav(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Position k of n, with the answer before and after."""
    own = rows.select(key, *[c for c in order if c != key], *({value} - {key, *order}))
    made = stitched(own, key, list(order), k=(PLACE, None), n=(COUNT, None), previous=(PREVIOUS, value), next=(NEXT, value))
    return made.select(key, *[c for c in order if c != key], (F.col("k") + 1).alias("k"), "n", "previous", "next")


def answer_at(rows: DataFrame, key: str, order: tuple[str, ...], k: Column | int) -> DataFrame:
    """The k-th answer of every key."""
    k = k if isinstance(k, Column) else F.lit(k)
    return numbered(rows, key, list(order), "_k").filter(F.col("_k") + 1 == k).drop("_k")
