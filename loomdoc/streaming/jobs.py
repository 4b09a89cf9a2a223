"""Structured Streaming forms: windowed usage, deduplication, static joins, incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_usage(events: DataFrame, at: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts by day and keys; a day is final once the watermark has passed it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding_usage(events: DataFrame, at: str, size: str, slide: str, late: str) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def dedupe(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first of each key within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def with_static(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    return events.join(static, on, "left")


def for_each_batch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` on each micro-batch of what is there now (upserts, incremental graphs)."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
