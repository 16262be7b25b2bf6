"""Streaming jobs over event files. Each runs with the available-now trigger and ends with its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    ]
)


def event_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def incremental_counts(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> DataFrame:
    """Running counts per key, kept as one increment per micro-batch.

    Every batch writes its own counts under ``batch=<id>`` (a retried batch overwrites itself, so a
    failure counts nothing twice); the running table is the sum of the increments.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        n = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        n.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target).groupBy(*keys).agg(F.sum("n").alias("n"))


def deduplicated(stream: DataFrame, identity: list[str], delay: str, target: str, checkpoint: str) -> DataFrame:
    """Replayed events dropped within the watermark; the rest appended to a table."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(identity)
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target)


def burden_windows(stream: DataFrame, key: str, size: str, delay: str, target: str, checkpoint: str) -> DataFrame:
    """Tumbling count and sum per entity. State is bounded by the watermark; every batch upserts the
    windows it changed, the last version of a window wins."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col("window.start").alias("start"), key, "n", "total")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    agg.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    all_versions = stream.sparkSession.read.parquet(target)
    return all_versions.groupBy("start", key).agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
