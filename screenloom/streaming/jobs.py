"""Structured Streaming forms of the capture and history jobs.

Every function takes a streaming DataFrame and returns one; the caller starts it, inside
``state_store`` if it keeps state of its own. State is bounded by watermarks: rows that wait for
their turn leave when the watermark passes them, and a key that can no longer matter is forgotten
by a timer. Rows later than the watermark take no part, nor do rows without a time or of before 1970,
where watermarks begin.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from screenloom.functions.text import strip
from screenloom.sources.shared import fresh_dir

INTERVAL = "15 seconds"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: No row is as late as this; an end mark is.
END = "9000-01-01 00:00:00"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within, streams that start keep their state in the store that custom state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Ending:
    """A folder for the mark that a stream ends: with it the watermark passes all rows.

    Rows wait for a watermark that only later rows move, so the last ones of a stream that ends
    would wait for good.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, fresh_dir(spark, "ending"), None

    def joined_to(self, rows: DataFrame) -> DataFrame:
        self.schema = ST.StructType([ST.StructField(f.name, f.dataType) for f in rows.schema])
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        return rows.union(self.spark.readStream.schema(self.schema).parquet(self.path))

    def mark(self) -> None:
        row = self.spark.range(1).select(*[(F.lit(END) if f.name == "at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        row.write.mode("append").parquet(self.path)


def capture_stream(spark: SparkSession, path: str, schema: ST.StructType, files: int | None = None) -> DataFrame:
    """A folder that files arrive in, as a stream; start it with a processing-time trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def in_time(rows: DataFrame, late: str, ending: Ending | None) -> DataFrame:
    """Rows with their time as watermark, and with the ending's mark, which moves it and goes no further."""
    timed = rows.withColumn("at", F.timestamp_seconds("ts_s")).filter("at IS NOT NULL")
    timed = ending.joined_to(timed) if ending else timed
    return timed.withWatermark("at", late).filter(F.col("at") < F.lit(END).cast("timestamp"))


def event_time(rows: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    return rows.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", late)


def interval_counts(rows: DataFrame, every: str = INTERVAL) -> DataFrame:
    """Events in each polling interval; append mode closes a window at the watermark."""
    counted = rows.groupBy(F.window("at", every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), "n")


def live_activity(rows: DataFrame, activity: str = "event_type") -> DataFrame:
    """Events of each kind a day, updated as they come."""
    counted = rows.groupBy(F.window("at", "1 day").alias("w"), activity).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), activity, "n")


def merge_lines(captures: DataFrame, key: str = "source", late: str = "1 day") -> DataFrame:
    """Each distinct line of a session once; a line is forgotten when the watermark passes it."""
    timed = captures.withColumn("at", F.timestamp_seconds("ts_s")).withWatermark("at", late)
    lines = timed.select(key, "at", F.explode(F.split("text", "\n")).alias("raw"))
    lines = lines.select(key, "at", strip(F.col("raw")).alias("line")).filter(F.col("line") != "")
    return lines.dropDuplicatesWithinWatermark([key, "line"]).select(key, "line")


def log_sink(rows: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch to the log, a folder a day, each row once whatever restarts."""
    dated = rows.withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))
    writer = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("day").outputMode("append")


def _state(*fields: tuple[str, ST.DataType]) -> ST.StructType:
    return ST.StructType([ST.StructField(name, kind) for name, kind in fields])


#: Users whose state is held together: a call to the state costs the same whatever it moves.
GROUPS = 1024


def group_of(user: str) -> Column:
    """The number of a user's group; rows without user are a group of their own, -1."""
    return F.when(F.col(user).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(user), F.lit(GROUPS))).cast("long")


def known(column: str) -> Column:
    """An id, 0 for null: a null would make the column one of floats."""
    return F.coalesce(F.col(column).cast("long"), F.lit(0)).alias(column)


def ids_of(values: np.ndarray, known: np.ndarray) -> pd.arrays.IntegerArray:
    """Ids as a column, null where they are not known."""
    return pd.arrays.IntegerArray(values.astype("int64"), ~known)


def as_rows(part: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    rows = np.empty(len(part), kind)
    for name in kind.names:
        rows[name] = part[name]
    return rows


class _Timed(StatefulProcessor):
    """A key with one timer, moved to the earliest time that is asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", _state(("ms", ST.LongType())))

    def wake(self, ms: int, anew: bool = False) -> None:
        """Wake at ``ms`` at the latest; ``anew`` after a timer has gone off, or to put it off."""
        set_for = self.timer.get()
        if set_for is not None and (anew or ms < set_for[0]):
            self.handle.deleteTimer(set_for[0])
            set_for = None
        if set_for is None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def close(self) -> None:
        pass


class _Change(_Timed):
    """Similarity of each frame to the one before, across batches.

    Frames count from 0. One that comes before its turn waits by its position; when the watermark
    has passed what waits, the frames that are missing are given up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        vec = ("vec", ST.ArrayType(ST.DoubleType()))
        self.last = handle.getValueState("last", _state(("position", ST.LongType()), vec))
        self.early = handle.getMapState("early", _state(("position", ST.LongType())), _state(vec))

    def judged(self, key, position: int, vec, before) -> tuple:
        import numpy as np

        r = 0.0
        if before is not None and len(before) == len(vec):
            a, b = vec - vec.mean(), before - before.mean()
            d = np.sqrt((a @ a) * (b @ b))
            r = float(a @ b / d) if d > 0 else 0.0
        return key[0], int(position), round(r, 6), bool(r > 0.95 and before is not None)

    def frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["seq_id", "position", "similarity", "stop"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        held, latest = self.last.get(), 0
        done, before = (-1, None) if held is None else (held[0], np.array(held[1], float))
        for part in rows:
            out, part = [], part.sort_values("position")
            latest = max(latest, int(part["ts_s"].max()) * 1000)
            for position, vec in zip(part["position"], part["vec"], strict=True):
                if position > done + 1:
                    self.early.updateValue((int(position),), ([float(x) for x in vec],))
                elif position == done + 1:
                    vec = np.array(vec, float)
                    out.append(self.judged(key, position, vec, before))
                    done, before = int(position), vec
                    while self.early.containsKey((done + 1,)):
                        vec = np.array(self.early.getValue((done + 1,))[0], float)
                        self.early.removeKey((done + 1,))
                        done += 1
                        out.append(self.judged(key, done, vec, before))
                        before = vec
            yield self.frame(out)
        if before is not None:
            self.last.update((done, before.tolist()))
        # put off while frames come
        set_for = self.timer.get()
        self.wake(max(latest, set_for[0] if set_for else 0), anew=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import numpy as np

        held, out = self.last.get(), []
        before = None if held is None else np.array(held[1], float)
        for (position,), (vec,) in sorted(self.early.iterator(), key=lambda x: x[0][0]) if self.early.exists() else ():
            vec = np.array(vec, float)
            out.append(self.judged(key, position, vec, before))
            before = vec
        for state in (self.last, self.early, self.timer):
            state.clear()
        yield self.frame(out)


class _Bounded(_Timed):
    """A list that is cut to its last 15 whenever it outgrows 20; emits it after each batch.

    How long the list is follows from the number of rows, and what is in it from their order, so
    a count and the newest 20 are all that is held, and rows may come in any order.
    """

    most, keep = 20, 15

    def __init__(self, idle: int):
        self.idle = idle

    def left(self, n: int) -> int:
        """The list's length after n rows."""
        return n if n <= self.most else self.keep + (n - self.most - 1) % (self.most + 1 - self.keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getListState("rows", _state(("ts_s", ST.LongType()), ("id", ST.LongType())))
        self.count = handle.getValueState("count", _state(("n", ST.LongType())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = [tuple(map(int, r)) for r in self.rows.get()] if self.rows.exists() else []
        count = self.count.get()
        n = count[0] if count is not None else 0
        for part in rows:
            n += len(part)
            part = part[["ts_s", "id"]].sort_values(["ts_s", "id"]).tail(self.most)
            newest = sorted([*newest, *((int(ts), int(i)) for ts, i in zip(part["ts_s"], part["id"], strict=True))])[-self.most :]
        size = self.left(n)
        self.rows.put(newest)
        self.count.update((n,))
        self.wake((newest[-1][0] + self.idle) * 1000, anew=True)
        held = newest[-size:]
        yield pd.DataFrame({"user_id": [key[0]], "size": [len(held)], "first_id": [held[0][1]], "last_id": [held[-1][1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.rows, self.count, self.timer):
            state.clear()
        yield pd.DataFrame(columns=["user_id", "size", "first_id", "last_id"])


ACTION = np.dtype([("user_id", "<i8"), ("ts_s", "<i8"), ("named", "?"), ("id", "<i8")])
_IN_ORDER = ("id", "named", "ts_s", "user_id")


class _BoundedGroup(_Bounded):
    """The lists of a group of users: those with new rows are read, written and given, in one frame."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        _Timed.init(self, handle)
        self.lists = handle.getMapState("lists", _state(("user_id", ST.LongType())), _state(("n", ST.LongType()), ("newest", ST.BinaryType())))

    def joined(self, n: int, newest: np.ndarray, more: int, rows: np.ndarray) -> tuple[int, np.ndarray]:
        met = np.concatenate([newest, rows])
        return n + more, met[np.lexsort([met[c] for c in _IN_ORDER])][-self.most :]

    def expiry(self, newest: np.ndarray) -> int:
        return (int(newest["ts_s"][-1]) + self.idle) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        none, met = (0, np.empty(0, ACTION)), {}
        for part in rows:
            actions = as_rows(part, ACTION)
            actions = actions[np.lexsort([actions[c] for c in _IN_ORDER])]
            users, starts, counts = np.unique(actions["user_id"], return_index=True, return_counts=True)
            for user, start, n in zip(users.tolist(), starts.tolist(), counts.tolist(), strict=True):
                met[user] = self.joined(*met.get(user, none), n, actions[max(start, start + n - self.most) : start + n])
        size, first, last = [], [], []
        for user, new in met.items():
            held = self.lists.getValue((user,))
            n, newest = new if held is None else self.joined(int(held[0]), np.frombuffer(bytes(held[1]), ACTION), *new)
            self.lists.updateValue((user,), (n, newest.tobytes()))
            self.wake(self.expiry(newest))
            size.append(self.left(n))
            first.append(newest[-size[-1]])
            last.append(newest[-1])
        first, last = np.array(first, ACTION), np.array(last, ACTION)
        user = ids_of(last["user_id"], np.full(len(last), key[0] >= 0))
        return iter([pd.DataFrame({"user_id": user, "size": size, "first_id": ids_of(first["id"], first["named"]), "last_id": ids_of(last["id"], last["named"])})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, over, later = timerValues.getCurrentWatermarkInMs(), [], None
        for (user,), (_, newest) in self.lists.iterator() if self.lists.exists() else ():
            at = self.expiry(np.frombuffer(bytes(newest), ACTION))
            if at <= passed:
                over.append(int(user))
            else:
                later = at if later is None else min(at, later)
        for user in over:
            self.lists.removeKey((user,))
        self.timer.clear()
        if later is not None:
            self.wake(later)
        return iter(())


#: Questions that wait in one piece.
CHUNK = 1024
QUESTION = np.dtype([("user_id", "<i8"), ("ts_s", "<i8"), ("named", "?"), ("question_id", "<i8"), ("empty", "?")])
PAUSE = np.dtype([("user_id", "<i8"), ("ts_s", "<i8")])


class _Cooldown(_Timed):
    """Accepts a question only some seconds after the last accepted one of its user; a key is a group of users.

    Questions wait until the watermark has passed them and are then judged in order of time, so it
    does not matter in which order, or in which batch, they came. They wait in chunks that follow
    each other in time, and only chunks with questions that are due are read.
    """

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", _state(("pauses", ST.BinaryType())))
        self.waiting = handle.getMapState("waiting", _state(("since_s", ST.LongType()), ("chunk", ST.LongType())), _state(("questions", ST.BinaryType())))
        self.chunks = handle.getValueState("chunks", _state(("n", ST.LongType())))

    def wait(self, questions: np.ndarray) -> None:
        """Put them away in chunks, by time."""
        seen, questions = self.chunks.get(), questions[np.argsort(questions["ts_s"], kind="stable")]
        n = 0 if seen is None else int(seen[0])
        for k in range(0, len(questions), CHUNK):
            part = questions[k : k + CHUNK]
            self.waiting.updateValue((int(part["ts_s"][0]), n), (part.tobytes(),))
            n += 1
        self.chunks.update((n,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            questions = as_rows(part, QUESTION)
            self.wait(questions)
            self.wake(int(questions["ts_s"].min()) * 1000)
        return iter(())

    def judged(self, questions: np.ndarray, last: dict[int, int], users: bool) -> pd.DataFrame:
        """Questions in order, with their status; ``last`` has each user's last accepted time, and is kept up."""
        status, remaining = [], []
        for user, ts, empty in zip(*(questions[c].tolist() for c in ("user_id", "ts_s", "empty")), strict=True):
            before = last.get(user)
            wait = before is not None and ts - before < self.seconds
            status.append("wait" if wait else "ignored" if empty else "accepted")
            remaining.append(int(self.seconds - (ts - before)) if wait else 0)
            if not wait and not empty:
                last[user] = ts
        return pd.DataFrame({
            "question_id": ids_of(questions["question_id"], questions["named"]), "user_id": ids_of(questions["user_id"], np.full(len(questions), users)),
            "ts_s": questions["ts_s"], "status": status, "remaining": remaining,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        keys = [tuple(map(int, k)) for k in self.waiting.keys()] if self.waiting.exists() else []
        read = [k for k in keys if k[0] * 1000 <= passed]
        # none but its first rows may be due
        questions = np.concatenate([np.empty(0, QUESTION), *(np.frombuffer(bytes(self.waiting.getValue(k)[0]), QUESTION) for k in read)])
        for k in read:
            self.waiting.removeKey(k)
        due = questions["ts_s"] * 1000 <= passed
        early, questions = questions[~due], questions[due]
        questions = questions[np.lexsort([questions[c] for c in ("empty", "question_id", "named", "ts_s", "user_id")])]
        held = self.last.get()
        held = np.frombuffer(bytes(held[0]), PAUSE) if held is not None else np.empty(0, PAUSE)
        last = dict(zip(held["user_id"].tolist(), held["ts_s"].tolist(), strict=True))
        for k in range(0, len(questions), 10 * CHUNK):
            yield self.judged(questions[k : k + 10 * CHUNK], last, key[0] >= 0)
        # a last accepted time matters until the pause is over
        over = {user: int((ts + self.seconds) * 1000) for user, ts in last.items()}
        held = np.array([(user, ts) for user, ts in last.items() if over[user] > passed], PAUSE)
        if len(held):
            self.last.update((held.tobytes(),))
        else:
            self.last.clear()
        self.timer.clear()
        if len(early):
            self.wait(early)
        later = [k[0] for k in keys if k[0] * 1000 > passed] + early["ts_s"].tolist()
        if later:
            self.wake(min(later) * 1000)
            return
        self.waiting.clear()
        self.chunks.clear()
        if len(held):
            self.wake(max(over.values()))


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, "EventTime")


def change(frames: DataFrame, late: str = "1 hour", ending: Ending | None = None) -> DataFrame:
    """Of frames (seq_id, position, vec, ts_s): each one's similarity to the frame before."""
    rows = in_time(frames.select("seq_id", "position", "vec", "ts_s"), late, ending)
    return _stateful(rows, "seq_id", _Change(), "seq_id long, position int, similarity double, stop boolean", "Append")


def bounded_history(actions: DataFrame, late: str = "1 hour", idle: int = 90 * 86400, ending: Ending | None = None) -> DataFrame:
    """A user's list after each batch; a user without actions for ``idle`` seconds is forgotten."""
    own = actions.select(group_of("user_id").alias("users"), known("user_id"), "ts_s", F.col("id").isNotNull().alias("named"), known("id"))
    return _stateful(in_time(own, late, ending), "users", _BoundedGroup(idle), "user_id long, size long, first_id long, last_id long", "Update")


def cooldown(questions: DataFrame, seconds: float, late: str = "1 hour", ending: Ending | None = None) -> DataFrame:
    """Every question with its status, once the watermark has passed it."""
    empty = F.trim(F.coalesce("question", F.lit(""))) == ""
    own = questions.select(group_of("user_id").alias("users"), known("user_id"), "ts_s", F.col("question_id").isNotNull().alias("named"), known("question_id"), empty.alias("empty"))
    schema = "question_id long, user_id long, ts_s long, status string, remaining long"
    return _stateful(in_time(own, late, ending), "users", _Cooldown(seconds), schema, "Append")
