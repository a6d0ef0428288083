"""Streaming ingestion: the same aggregations over bounded tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and totals per window and type; on a stream, rows later than ``late`` are dropped and windows close."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_folder(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed windows as Parquet, exactly once; reads what is there and stops."""
    flat = stream.select("event_type", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
    return flat.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def progress(query) -> dict:
    """Status of a running query: state, rows so far and message, as the job status of a service would give it."""
    last = query.lastProgress
    return {"status": "running" if query.isActive else "stopped", "rows": last.numInputRows if last else 0, "message": query.status["message"]}
