"""Streams of interactions: windowed counts with a watermark. An addition for ``events``; batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def item_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, item_idx, n, users: interactions by item and window; rows later than the watermark are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    item = F.get_json_object("props", "$.k").cast("long").alias("item_idx")
    counts = rows.groupBy(F.window("at", width).alias("w"), item).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counts.select(F.col("w.start").alias("start"), "item_idx", "n", "users")
