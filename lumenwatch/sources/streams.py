"""Streaming log source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.schemas import LOGS



def file_log_stream(spark: SparkSession, path: str, schema: str = LOGS, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New files below a folder, oldest first; all there are per trigger unless bounded."""
    return _bounded(spark.readStream.schema(schema), files_per_trigger).format(fmt).load(path)


def text_record_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Raw records, one per line, as ``value``."""
    return _bounded(spark.readStream, files_per_trigger).format("text").load(path)


def _bounded(reader, files_per_trigger: int | None):
    return reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)


def topic_record_stream(
    spark: SparkSession, servers: str, topic: str = "raw-logs", records_per_trigger: int | None = None
) -> DataFrame:
    """Records of a topic from the earliest offset, as ``value`` with their position.

    Needs the Kafka connector on the class path. ``records_per_trigger`` defaults to no bound, because a
    micro-batch on a cluster should be large.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if records_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", records_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
