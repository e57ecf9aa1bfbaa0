"""Streaming source of sensor messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MESSAGE_SCHEMA = "topic string, value string, arrival_ts timestamp_ntz"


def read_sensor_stream(
    spark: SparkSession, path: str, topics: list[str] | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Messages that arrive as JSON lines in a folder: topic, value (payload text), arrival_ts.

    A message queue that yields the same three columns can take its place.
    """
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.json(path)
    return stream.filter(stream.topic.isin(*topics)) if topics else stream


def read_sample_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Metric samples that arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
