"""Grouped and whole-table aggregates. Spark pre-aggregates before each shuffle, so a key that
holds most rows sends one partial row per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.columns import decade_label
from tallymill.functions.measures import Measure, measure_column

Keys = Sequence[str] | Mapping[str, Column]


def drop_sentinel(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    """Drop rows that hold the sentinel; NULL is dropped with it."""
    return df.filter(F.col(column) != sentinel)


def top_k(df: DataFrame, order: Sequence[Column], k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The first ``k`` rows in ``order``; each task keeps only its own best ``k``."""
    best = df.orderBy(*order).limit(k)
    return best.select(*columns) if columns else best


def _key_columns(keys: Keys) -> list[Column]:
    if isinstance(keys, Mapping):
        return [c.alias(name) for name, c in keys.items()]
    return [F.col(k) for k in keys]


def group_stats(
    df: DataFrame,
    keys: Keys,
    measures: Mapping[str, Measure | tuple],
    where: Column | None = None,
    min_rows: int | None = None,
    order: Sequence[Column] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Filter, group, aggregate, drop groups under ``min_rows`` rows, order and limit."""
    if where is not None:
        df = df.filter(where)
    outputs = [measure_column(name, m) for name, m in measures.items()]
    size = "__rows"
    if min_rows is not None:
        outputs.append(F.count(F.lit(1)).alias(size))
    result = df.groupBy(*_key_columns(keys)).agg(*outputs)
    if min_rows is not None:
        result = result.filter(F.col(size) >= min_rows).drop(size)
    if order:
        result = result.orderBy(*order)
    return result if top is None else result.limit(top)


def decade_trend(
    df: DataFrame, year: str, measures: Mapping[str, Measure | tuple], low: int, high: int
) -> DataFrame:
    """``measures`` per decade for years in [low, high), in order of the label."""
    y = F.col(year)
    return group_stats(
        df,
        {"decade": decade_label(y)},
        measures,
        where=(y >= low) & (y < high),
        order=[F.col("decade").asc()],
    )


def cross_count(df: DataFrame, buckets: Mapping[str, Column]) -> DataFrame:
    """Row counts for every combination of the bucket labels that occurs."""
    return group_stats(df, buckets, {"count": ("count",)}, order=[F.col(name).asc() for name in buckets])


def table_summary(df: DataFrame, measures: Mapping[str, Measure | tuple]) -> DataFrame:
    """One row of measures over the whole table."""
    return df.agg(*[measure_column(name, m) for name, m in measures.items()])


def top_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its count; the smaller value wins a tie, NULL loses it."""
    return group_stats(
        df,
        [column],
        {"count": ("count",)},
        order=[F.col("count").desc(), F.col(column).asc_nulls_last()],
        top=1,
    )


def distinct_count(df: DataFrame, column: str, count_null: bool = True) -> DataFrame:
    """Number of distinct values; NULL counts as one unless told otherwise."""
    n = F.count_distinct(F.col(column))
    if count_null:
        n = n + F.coalesce(F.max(F.col(column).isNull().cast("bigint")), F.lit(0))
    return df.agg(n.alias("distinct_count"))
