"""Streaming forms of gates, digests and journals (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n, total of event-time windows; rows later than the watermark are dropped, windows end behind it."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def gated(events: DataFrame, reason: Column) -> DataFrame:
    """Stateless: rows with their reason code; the same expression as in batch."""
    return events.withColumn("reason_code", reason)


def deduplicated(events: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """First sight of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_balance(events: DataFrame, key: str, cost: str, budget: float) -> DataFrame:
    """key, spent, remaining of the keys that a batch changes (update mode): a sum a key is all the state."""
    out = events.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.coalesce(F.sum(F.col(cost).cast("double")), F.lit(0.0)).alias("spent"))
    return out.withColumn("remaining", F.lit(float(budget)) - F.col("spent"))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, and gives the sink's rows as a table (for bounded inputs and tests)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
