"""Streams: new files through a batch plan, and counts of late and repeated events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow_folder(spark: SparkSession, folder: str, schema: StructType, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``plan`` over each batch of new Parquet files in ``folder``, writing one subfolder a batch, so that a batch done twice leaves one result."""

    def run(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """(window_start, keys, n): counts by event-time window, exact repeats within the allowed lateness counted once."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark([at, *keys])
    return once.groupBy(F.window(at, window).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("window_start"), *keys, "n")
