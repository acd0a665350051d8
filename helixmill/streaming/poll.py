"""Polling for new records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def new_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def process_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to parquet files, then stop.

    The checkpoint takes the place of claims and ETags: rows are handled once.
    """
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key in windows of time; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
