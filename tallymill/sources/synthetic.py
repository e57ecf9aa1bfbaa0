"""Numeric tables for load tests: id, category 0..9, value 0..1000, quantity 1..20, flag 0..1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_table(spark: SparkSession, rows: int, partitions: int | None = None, seed: int = 7) -> DataFrame:
    """``rows`` random rows, repeatable for one seed and partition count.

    ``spark.range`` already yields even partitions, so no shuffle is needed to balance them.
    """
    return spark.range(0, rows, 1, partitions).select(
        "id",
        (F.rand(seed) * 10).cast("int").alias("category"),
        (F.rand(seed + 1) * 1000).alias("value"),
        (F.rand(seed + 2) * 20 + 1).cast("int").alias("quantity"),
        (F.rand(seed + 3) * 2).cast("int").alias("flag"),
    )


def add_synthetic_columns(df: DataFrame, key: str) -> DataFrame:
    """The same columns from integer arithmetic on a BIGINT key, for engines without our ``rand``."""
    k = F.col(key)
    return df.select(
        k.alias("id"),
        F.pmod(k * 7919, F.lit(10)).cast("int").alias("category"),
        (F.pmod(k * 104729, F.lit(1_000_000)) / 1000).alias("value"),
        (F.pmod(k * 31, F.lit(20)) + 1).cast("int").alias("quantity"),
        F.pmod(k, F.lit(2)).cast("int").alias("flag"),
    )
