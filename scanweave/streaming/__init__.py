"""Incremental work: windows over event time, deduplication, and a watcher of new runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, ts: str, keys: tuple[str, ...], columns: tuple[Column, ...], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates in tumbling or sliding windows; ``start, end``, the keys and the columns. Batch and stream alike."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    out = own.groupBy(F.window(ts, width, slide or width), *keys).agg(*columns)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *[c for c in out.columns if c not in ("window", *keys)])


def sessions(events: DataFrame, ts: str, keys: tuple[str, ...], columns: tuple[Column, ...], gap: str, late: str = "10 minutes") -> DataFrame:
    """Aggregates in sessions that end after ``gap`` without an event of the keys."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    out = own.groupBy(F.session_window(ts, gap), *keys).agg(*columns)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *[c for c in out.columns if c not in ("session_window", *keys)])


def deduplicated(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """One event for each key; on a stream within the watermark, so that state stays bounded."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def watch(
    spark: SparkSession, folder: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "60 seconds",
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Files that appear in a folder go to ``process(batch, number)``, each once; ``once`` ends when all there are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
