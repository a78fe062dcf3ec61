"""Structured Streaming over variant and call files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(calls: DataFrame) -> DataFrame:
    """ALT, heterozygote and missing counts by variant over all calls so far; the state is a row for each variant."""
    yes = lambda c: F.count(F.when(c, 1))
    return calls.groupBy("var_id").agg(F.sum(F.when(~F.col("is_null"), F.col("ac"))).alias("ac"), yes((F.col("ac") == 1) & ~F.col("is_null")).alias("het"), yes(F.col("is_null")).alias("nul"))


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) by window and type; a window is final once `late` has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there and stops; a new call goes on where the last one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
