"""Rules and numbers inside keys, on small keys and on one key that holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from screenloom.operators import history
from screenloom.operators.ranges import COUNT, FIRST_FROM, LAST_BEFORE, NEXT, PLACE, PREVIOUS, stitched

QUESTIONS = "question_id long, user_id long, ts_s long, question string"


def walked(rows, seconds):
    """The rule as a loop."""
    out, last = [], {}
    for q, k, ts, text in sorted(rows, key=lambda r: (repr(r[1]), -1 if r[2] is None else r[2], -1 if r[0] is None else r[0], not (r[3] or "").strip())):
        at = last.get(k)
        wait, empty = at is not None and ts is not None and ts - at < seconds, ts is None or not (text or "").strip()
        out.append((q, k, ts, "wait" if wait else "ignored" if empty else "accepted", int(seconds - (ts - at)) if wait else 0))
        if not wait and not empty:
            last[k] = ts
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_cooldown_is_the_loop(spark, few):
    rng = random.Random(few)
    rows = [(i, rng.choice([1, 2, 3, 3, 3, None]), rng.randint(0, 900), rng.choice(["q", "", " ", None, "x?"])) for i in range(400)]
    rows += [(500, 9, 10, ""), (501, 9, 10, "q"), (502, 9, 10, "q"), (503, 9, 11, ""), (504, 9, 35, "q"), (505, 9, None, "q"), (506, 8, None, "q"), (None, 9, 36, "q"), (507, 7, 5, "")]
    df = spark.createDataFrame(rows, QUESTIONS)
    got = sorted((tuple(r) for r in history.cooldown(df, 25, few=few).collect()), key=repr)
    assert got == walked(rows, 25)
    assert history.cooldown(df.limit(0), 25, few=few).count() == 0


def test_repeated_rows_wait_for_the_first(spark):
    rows = [(1, 1, 0, "q"), (1, 1, 0, "q"), (2, 1, 30, "q")]
    for few in (0, 10):
        got = sorted(tuple(r) for r in history.cooldown(spark.createDataFrame(rows, QUESTIONS), 25, few=few).collect())
        assert got == [(1, 1, 0, "accepted", 0), (1, 1, 0, "wait", 25), (2, 1, 30, "accepted", 0)]


def test_stitched_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, i, i])) for k, n in ((1, 500), (2, 3), (None, 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, at long, v long").repartition(4)
    got = stitched(df, "k", ["at"], place=(PLACE, None), n=(COUNT, None), before=(PREVIOUS, "v"), after=(NEXT, "v"), held=(LAST_BEFORE, "v"), ahead=(FIRST_FROM, "v"))
    by = {}
    for k, _, v in rows:
        by.setdefault(k, []).append(v)
    assert got.count() == len(rows)
    for r in got.collect():
        vs, i = by[r.k], r.at
        assert (r.place, r.n, r.before, r.after) == (i, len(vs), vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None)
        assert r.held == next((v for v in reversed(vs[:i]) if v is not None), None)
        assert r.ahead == next((v for v in vs[i:] if v is not None), None)


def test_one_conversation_is_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.col("id").alias("response_id"), F.concat(F.lit("t"), F.col("id")).alias("response_text"))
    out = history.nav(rows, "conv_id", "response_text", ("turn", "response_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition(" in line and "response_text" in line:
            assert "_range#" in line.split("windowspecdefinition(")[1].split(" ASC")[0]
    first, last = out.filter("k = 1").first(), out.filter("k = 20000").first()
    assert (first.n, first.previous, first.next, last.previous, last.next) == (20_000, None, "t1", "t19998", None)
    assert history.answer_at(rows, "conv_id", ("turn", "response_id"), 7).first().turn == 6
