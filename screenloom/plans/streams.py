"""Runs a stream over what is there now and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from screenloom.sources.shared import fresh_dir
from screenloom.streaming.jobs import Ending, state_store


def run_to_table(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, ending: Ending | None = None, out: str | None = None, checkpoint: str | None = None, progress: list | None = None) -> DataFrame:
    """Every micro-batch is written to a table in the shared folder, in a folder named by the
    batch, so a repeated batch replaces itself.

    With ``keys`` the rows of later batches replace those of earlier ones. With ``ending`` the
    stream is stopped when all is read, and goes on from its checkpoint to the end mark. ``out``
    and ``checkpoint`` of an earlier run carry on from it. ``progress`` gets what the batches report.
    """
    spark = stream.sparkSession
    out, checkpoint = out or fresh_dir(spark, name), checkpoint or fresh_dir(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        start = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write)
        with state_store(spark):
            query = start.start()
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)

    run()
    if ending:
        ending.mark()
        run()
    written = spark.read.option("basePath", out).schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(out)
    return newest(written, keys) if keys else written.drop("batch")


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the number of their batch, the latest for each of ``keys``."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    found = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return found.select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in written.columns if c != "batch"])
