"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver, may do without that setting: it gets a
    temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths staged within the innermost open ``scratch``.
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged within are deleted at the end, but for what the yielded function stages.

    What leaves the block must come from that function: it depends on no other staged table.
    """
    paths: list[str] = []
    outer = _scratch.get()
    token = _scratch.set(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _scratch.set(outer)
        try:
            return staged(df, name)
        finally:
            _scratch.reset(inner)

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str, observe: dict[str, Column] | None = None):
    """Write ``df`` to the shared folder and read it back; with what was observed in writing, if asked.

    Cuts the lineage at a table that outlives any executor and that later steps scan with
    column pruning; each staged table is written once and read by path.
    """
    path = fresh_dir(df.sparkSession, name)
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    seen = Observation() if observe else None
    (df.observe(seen, *[c.alias(k) for k, c in observe.items()]) if observe else df).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return (table, seen.get) if observe else table
