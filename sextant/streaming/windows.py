"""Event-time operators on a stream of events (ts, user_id, event_type, value): additions beyond incremental batch.

Each works on a batch frame as well, with the same rows: watermarks only bound the state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream(spark, path: str) -> DataFrame:
    """The events of a folder of Parquet files as a stream; the schema is that of the files there."""
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by overlapping windows."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    return df.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, by id; the watermark bounds what is remembered."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_each(df: DataFrame, write, checkpoint: str):
    """Runs `write(batch, batch_id)` for each micro-batch: an idempotent keyed write makes it exactly once."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
