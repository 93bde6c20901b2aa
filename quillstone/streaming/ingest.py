"""Incremental ingestion: each message once, in batches that pick up where the last one stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def message_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """JSON files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def unique(stream: DataFrame, key: str, time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First row of each key. With a time column the state is bounded: repeats are dropped within the delay."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes everything that is there now as Parquet and ends; the checkpoint makes the next call go on from there."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation",
        checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows; late ones count within the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"),
        kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def pointer_stream(observations: DataFrame, keys: list[str], version: str, order: str) -> DataFrame:
    """The version of each document observed last, in update mode: a repeated older version moves the pointer back to it."""
    return observations.groupBy(*keys).agg(F.max_by(version, F.struct(order, version)).alias(version), F.max(order).alias(order))
