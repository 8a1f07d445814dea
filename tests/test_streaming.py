"""Streams against their batch forms, with one and with many files a batch."""

import os
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from screenloom.operators import captures, history
from screenloom.plans.streams import run_to_table
from screenloom.sources import sinks
from screenloom.sources.shared import fresh_dir
from screenloom.sources.tables import read_log, view
from screenloom.streaming import jobs


def arrive(df, name, parts, *order):
    """The rows as files whose names keep the order, so that batches come in order."""
    path = fresh_dir(df.sparkSession, name)
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        df.sparkSession.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def shuffled(df, name, parts, *order, backwards=False):
    """The rows as files in an order of their own; backwards, the last in time come first."""
    path = fresh_dir(df.sparkSession, name)
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    files = [rows[k * step : (k + 1) * step] for k in range(parts)]
    for part in reversed(files) if backwards else files:
        df.sparkSession.createDataFrame(part[::-1] if backwards else part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def same_rows(got, want):
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize(("parts", "backwards"), [(1, False), (3, False), (3, True)])
def test_cooldown_across_batches(spark, sf, parts, backwards):
    """In any order of files and rows, the stream answers as the batch does; then it holds nothing."""
    questions = view(spark, sf, "questions").filter("user_id < 40")
    path, ending, seen = shuffled(questions, "q", parts, "ts_s", "question_id", backwards=backwards), jobs.Ending(spark), []
    stream = jobs.cooldown(jobs.capture_stream(spark, path, questions.schema, 1), 86400, "60 days", ending)
    same_rows(run_to_table(stream, "cooldown", ending=ending, progress=seen), history.cooldown(questions, 86400))
    assert seen[-1].stateOperators[0].numRowsTotal == 0


def test_cooldown_judges_as_the_watermark_passes(spark, sf):
    """With files in order a short wait does, and rows leave the state while the stream goes on."""
    questions = view(spark, sf, "questions").filter("user_id < 40")
    path, ending, seen = shuffled(questions, "q", 4, "ts_s", "question_id"), jobs.Ending(spark), []
    stream = jobs.cooldown(jobs.capture_stream(spark, path, questions.schema, 1), 86400, "1 second", ending)
    same_rows(run_to_table(stream, "cooldown", ending=ending, progress=seen), history.cooldown(questions, 86400))
    assert max(p.stateOperators[0].numRowsTotal for p in seen) < questions.count()


@pytest.mark.parametrize(("parts", "backwards"), [(1, False), (3, False), (3, True)])
def test_bounded_history_across_batches(spark, sf, parts, backwards):
    actions = view(spark, sf, "actions").filter("user_id < 6").select("user_id", "id", "ts_s")
    path, ending, seen = shuffled(actions, "a", parts, "ts_s", "id", backwards=backwards), jobs.Ending(spark), []
    stream = jobs.bounded_history(jobs.capture_stream(spark, path, actions.schema, 1), "60 days", ending=ending)
    got = run_to_table(stream, "bounded", "update", ["user_id"], ending, progress=seen)
    kept = history.bounded(actions, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.struct("ts_s", "id")).alias("first_id"), F.max_by("id", F.struct("ts_s", "id")).alias("last_id"))
    same_rows(got, kept)
    assert seen[-1].stateOperators[0].numRowsTotal == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_change_takes_frames_in_any_order(spark, sf, parts):
    frames = view(spark, sf, "frames").select(F.col("seq_id").cast("long"), "position", F.col("vec").cast("array<double>").alias("vec"), (F.col("seq_id") + F.col("position") + 1000).cast("long").alias("ts_s"))
    # one sequence lacks a frame
    frames = frames.filter("NOT (seq_id = 16 AND position = 5)")
    want = captures.similarity_to_previous(frames).select(F.col("seq_id").cast("long").alias("seq_id"), "position", F.round("similarity", 6).alias("similarity"))
    path, ending, seen = shuffled(frames.withColumn("h", F.xxhash64("seq_id", "position")), "f", parts, "h"), jobs.Ending(spark), []
    stream = jobs.change(jobs.capture_stream(spark, path, StructType([*frames.schema, StructField("h", LongType())]), 1), "1 day", ending)
    got = run_to_table(stream, "change", ending=ending, progress=seen)
    same_rows(got.select("seq_id", "position", "similarity"), want)
    assert seen[-1].stateOperators[0].numRowsTotal == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_live_activity_replaces_what_a_batch_updates(spark, sf, parts):
    events = view(spark, sf, "actions")
    path, out, checkpoint = shuffled(events, "v", parts, "ts_s"), fresh_dir(spark, "live"), fresh_dir(spark, "live-checkpoint")
    stream = jobs.live_activity(jobs.in_time(jobs.capture_stream(spark, path, events.schema, 1), "60 days", None), "action_type")
    got = run_to_table(stream, "live", "update", ["start_s", "action_type"], out=out, checkpoint=checkpoint)
    want = jobs.live_activity(events.withColumn("at", F.timestamp_seconds("ts_s")), "action_type")
    same_rows(got, want)
    # the last batch again, as after a failure between its writing and its commit
    last = max(int(p.removesuffix(".crc").lstrip(".")) for p in os.listdir(f"{checkpoint.removeprefix('file://')}/commits"))
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{checkpoint.removeprefix('file://')}/commits/{name}")
    same_rows(run_to_table(stream, "live", "update", ["start_s", "action_type"], out=out, checkpoint=checkpoint), want)


def test_the_log_goes_on_where_it_stopped_and_reads_by_day(spark, sf):
    actions = view(spark, sf, "actions").withColumn("id", F.col("id").cast("long"))
    rows = actions.orderBy("ts_s").collect()
    source, log, checkpoint = fresh_dir(spark, "s"), fresh_dir(spark, "log"), fresh_dir(spark, "log-checkpoint")
    for k in range(3):
        # each time the stream starts anew, from its checkpoint
        spark.createDataFrame(rows[k::3], actions.schema).coalesce(1).write.mode("append").parquet(source)
        stream = sinks.action_rows(jobs.capture_stream(spark, source, actions.schema, 1))
        jobs.log_sink(stream, log, checkpoint).trigger(availableNow=True).start().awaitTermination()
    same_rows(read_log(spark, log), sinks.action_rows(actions))
    since, until = 1704067200 + 3 * 86400 + 100, 1704067200 + 5 * 86400
    some = read_log(spark, log, since, until)
    same_rows(some, sinks.action_rows(actions).filter((F.col("timestamp") >= since) & (F.col("timestamp") < until)))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    batch = fresh_dir(spark, "batch-log")
    sinks.log_actions(actions, batch)
    same_rows(read_log(spark, batch, since, until), some)


def test_streams_leave_the_session_as_it_was(spark, sf):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    questions = view(spark, sf, "questions").filter("user_id < 3")
    path, ending = shuffled(questions, "q", 1, "ts_s"), jobs.Ending(spark)
    run_to_table(jobs.cooldown(jobs.capture_stream(spark, path, questions.schema), 86400, "1 day", ending), "cooldown", ending=ending)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_interval_counts_close_with_the_watermark(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = arrive(events, "e", 2, "ts")
    stream = jobs.interval_counts(jobs.event_time(jobs.capture_stream(spark, path, events.schema, 1)), "1 day")
    got = {r.start_s: r.n for r in run_to_table(stream, "intervals").collect()}
    want = {r.start_s: r.n for r in jobs.interval_counts(events.withColumn("at", F.col("ts").cast("timestamp")), "1 day").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 2


class Value:
    """A state that is held in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    put = update


class Timers:
    def registerTimer(self, ms):
        self.ms = ms

    def deleteTimer(self, ms):
        assert ms == self.ms


def chunks(n, step, order):
    """Frames of one user's rows, and the frames that are still held when the next is made."""
    alive, most = [], []

    def make():
        for k in range(0, n, step):
            part = order[k : k + step]
            frame = pd.DataFrame({"id": part, "ts_s": [10 * x for x in part]})
            alive.append(weakref.ref(frame))
            most.append(sum(r() is not None for r in alive))
            yield frame
            del frame

    return make(), most


@pytest.mark.parametrize("n", [1, 20, 21, 26, 27, 200])
def test_bounded_history_holds_one_chunk(n):
    order = [(k * 7919) % n for k in range(n)]
    p = jobs._Bounded(100)
    p.rows, p.count, p.timer, p.handle = Value(), Value(), Value(), Timers()
    held = []
    made, most = chunks(n, 5, order)
    size = list(p.handleInputRows((1,), made, None))[0]["size"][0]
    for k in sorted(order):
        held.append(k)
        held = held[-15:] if len(held) > 20 else held
    assert [r[1] for r in p.rows.value][-size:] == held and size == len(held) and max(most) <= 2 and len(p.rows.value) <= 20
    assert p.handle.ms == (10 * (n - 1) + 100) * 1000


@pytest.mark.parametrize("parts", [1, 3])
def test_lines_are_given_once_over_all_batches(spark, sf, parts):
    rows = view(spark, sf, "captures").filter("capture_id < 60").select("capture_id", "source", "ts_s", "text")
    # the same lines again, under later captures
    rows = rows.union(rows.select(F.col("capture_id") + 1000, "source", F.col("ts_s") + 60, "text"))
    path = shuffled(rows, "m", parts, "capture_id")
    got = run_to_table(jobs.merge_lines(jobs.capture_stream(spark, path, rows.schema, 1), late="60 days"), "merge")
    same_rows(got, captures.merged_lines(rows).select("source", "line"))


def test_cooldown_holds_state_by_groups_of_users(spark):
    """What is held, and so the calls to the state, does not grow with the users; ids may be null or large."""
    users, big = 5000, 2**53 + 1
    rows = [(u, big + 2 * u + k, 1_700_000_000 + 50_000 * k + u, "" if (u + k) % 7 == 0 else "what?") for u in range(users) for k in range(3)]
    rows += [(None, k if k % 3 else None, 1_700_000_000 + 30_000 * k, "why?") for k in range(9)] + [(big, None, 1_700_000_000, "why?"), (big, 1, 1_700_000_000, None)]
    questions = spark.createDataFrame(rows, "user_id long, question_id long, ts_s long, question string")
    path, ending, seen = shuffled(questions, "q", 1, "ts_s"), jobs.Ending(spark), []
    stream = jobs.cooldown(jobs.capture_stream(spark, path, questions.schema), 86400, "60 days", ending)
    same_rows(run_to_table(stream, "cooldown", ending=ending, progress=seen), history.cooldown(questions, 86400))
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in seen) <= 3 * (1024 + 1)
    assert seen[-1].stateOperators[0].numRowsTotal == 0


class Entries(dict):
    """A state of keys and values that is held in memory."""

    read = 0

    def exists(self):
        return len(self) > 0

    def getValue(self, key):
        self.read += 1
        return self[key]

    updateValue, removeKey = dict.__setitem__, dict.__delitem__


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_cooldown_reads_only_what_is_due():
    p = jobs._Cooldown(100)
    p.last, p.chunks, p.timer, p.handle, p.waiting = Value(), Value(), Value(), Timers(), Entries()
    rows = pd.DataFrame([(k % 3, (k * 7919) % 20000, True, k, k % 5 == 0) for k in range(20000)], columns=list(jobs.QUESTION.names))
    assert not list(p.handleInputRows((7,), iter([rows[:15000], rows[15000:]]), None))
    got, chunks = [], len(p.waiting)
    for passed in (4000, 4500, 30000):
        assert p.handle.ms <= passed * 1000
        got += [tuple(r) for f in p.handleExpiredTimer((7,), Now(passed * 1000), None) for r in f.itertuples(index=False)]
        # each chunk is read when it falls due, and again as the rest of one that was read
        assert p.waiting.read <= chunks + 4
    want, last = [], {}
    for user, ts, _, question, empty in rows.sort_values(["ts_s", "question_id"]).itertuples(index=False):
        wait = user in last and ts - last[user] < 100
        want.append((question, user, ts, "wait" if wait else "ignored" if empty else "accepted", 100 - (ts - last[user]) if wait else 0))
        if not wait and not empty:
            last[user] = ts
    assert sorted(got) == sorted(want) and not any(s.exists() for s in (p.waiting, p.last, p.chunks, p.timer))


def test_bounded_history_takes_null_ids_and_forgets_by_user(spark):
    """As the batch form, also without users or ids, over several files."""
    big = 2**53 + 1
    rows = [(u, big + 50 * u + k, 1_700_000_000 + 977 * ((k * 7) % 23)) for u in range(40) for k in range(u)]
    rows += [(None, None if k % 9 == 0 else k, 1_700_000_000 + k) for k in range(40)] + [(big, None, 1_700_000_000), (big + 1, 5, 1_700_000_000)]
    actions = spark.createDataFrame(rows, "user_id long, id long, ts_s long")
    path, ending, seen = shuffled(actions, "a", 3, "ts_s", backwards=True), jobs.Ending(spark), []
    got = run_to_table(jobs.bounded_history(jobs.capture_stream(spark, path, actions.schema, 1), "60 days", ending=ending), "bounded", "update", ["user_id"], ending, progress=seen)
    at = F.struct("ts_s", "id")
    same_rows(got, history.bounded(actions, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id")))
    assert seen[-1].stateOperators[0].numRowsTotal == 0


def test_a_group_gives_one_frame_and_forgets_the_idle():
    p = jobs._BoundedGroup(100)
    p.lists, p.timer, p.handle = Entries(), Value(), Timers()
    p.lists.getValue, p.lists.iterator = p.lists.get, lambda: list(p.lists.items())
    rows = pd.DataFrame([(k % 50, k // 50, True, k) for k in range(2000)], columns=["user_id", "ts_s", "named", "id"])
    [frame] = p.handleInputRows((3,), iter([rows[:700], rows[700:]]), None)
    assert frame["user_id"].tolist() == list(range(50)) and set(frame["size"]) == {16} and frame["last_id"].tolist() == list(range(1950, 2000))
    assert frame["first_id"].tolist() == [u + 24 * 50 for u in range(50)] and p.handle.ms == 139_000
    [frame] = p.handleInputRows((3,), iter([rows[:1].assign(ts_s=90, id=7)]), None)
    assert frame[["user_id", "size", "last_id"]].values.tolist() == [[0, 17, 7]]
    # the timer goes off for all but the user with a later row
    assert not list(p.handleExpiredTimer((3,), Now(139_000), None)) and list(p.lists) == [(0,)] and p.handle.ms == 190_000
    assert not list(p.handleExpiredTimer((3,), Now(190_000), None)) and not p.lists and not p.timer.exists()
