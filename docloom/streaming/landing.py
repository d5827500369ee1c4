"""Documents as they arrive in a folder, and sample statistics over time windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, folder: str, *, pattern: str = "*.pdf", files_per_trigger: int = 1) -> DataFrame:
    """A stream of the folder's new files; the limit admits so many documents at a time."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def process_arrivals(files: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, log: str | None = None) -> StreamingQuery:
    """Runs ``process`` on each admitted batch and appends what it gives to ``target``; ends when nothing is left.

    A batch is written under its number, so one that runs again replaces itself.  ``log`` gets the batch's
    ``processing_s`` in the same way.
    """

    def one(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if log is not None:
            took = batch.sparkSession.range(1).select(F.lit(time.perf_counter() - began).alias("processing_s"))
            took.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(samples: DataFrame, *, time: str = "ts", value: str = "value", key: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """min, max, mean and count in tumbling windows; on a stream, samples later than ``late`` are dropped."""
    timed = samples.withWatermark(time, late) if samples.isStreaming else samples
    out = timed.groupBy(F.window(time, length).alias("window"), key).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("samples"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "min", "max", "mean", "samples")


def with_status(results: DataFrame) -> DataFrame:
    """``status`` of a request by its ``reason``: 200, 400 (not supported, not found), 415 (scans off), 500."""
    reason = F.coalesce(F.col("reason"), F.lit(""))
    code = (
        F.when(reason == "", 200)
        .when(reason.contains("switched off"), 415)
        .when(reason.contains("not supported") | reason.contains("not found") | reason.contains("invalid"), 400)
        .otherwise(500)
    )
    return results.withColumn("status", code)
