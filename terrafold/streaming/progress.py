"""Progress events as a stream: the batch operators' results, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of events in a folder; the schema is that of the files that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def windowed_rates(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """window start, event_type, n: events in tumbling windows; state of windows older than ``late`` is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def latest_decisions(events: DataFrame) -> DataFrame:
    """user_id and the last decision of each user so far (for the update or complete mode)."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_type", "value")).alias("m")).select("user_id", "m.ts", "m.event_type", "m.value")
