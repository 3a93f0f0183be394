"""Streams of finished runs: counts by status, appends, and counts of late or timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Runs of a folder as their files arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_status").agg(F.count("*").alias("n"))


def timed_counts(events: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; state older than the watermark is given up."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"))


def append(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch written by its number, so that one that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
