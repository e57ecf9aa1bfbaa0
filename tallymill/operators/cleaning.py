"""Cleaning steps. Statistics a step needs are scalar subqueries, so the plan stays lazy:
Spark computes them once, on the pruned columns, and never brings them to Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.columns import is_missing
from tallymill.functions.constants import DEFAULT_SCORE


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Delete rows that are NULL or NaN in any of ``columns``."""
    return df.dropna(subset=list(columns))


def fill_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL (and NaN) by a constant per column; an unknown column is an error."""
    return df.fillna(dict(values))


def fill_mean(df: DataFrame, column: str, fallback: float = DEFAULT_SCORE) -> DataFrame:
    """Replace NULL and NaN by the mean of the other values, or ``fallback`` if there are none."""
    data_type = df.schema[column].dataType
    missing = is_missing(column, data_type)
    mean = df.agg(F.avg(F.when(~missing, F.col(column)))).scalar()
    filled = F.when(missing, F.coalesce(mean, F.lit(fallback))).otherwise(F.col(column))
    return df.withColumn(column, filled)


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop copies of whole rows."""
    return df.dropDuplicates()


def dedupe_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be a total order. NULL keys are equal.

    Spark keeps at most one row per key and task before the shuffle, so a key with very many
    copies costs no more than any other.
    """
    rank = "__copy"
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def total_order(df: DataFrame, keys: Sequence[str], first: Sequence[Column] = ()) -> list[Column]:
    """``first`` and then every other column ascending, NULLs last: the same survivor on every run."""
    return [*first, *[F.col(c).asc_nulls_last() for c in df.columns if c not in keys]]


def in_range(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def at_least_or_sentinel(column: str, low: float, sentinel: float) -> Column:
    c = F.col(column)
    return (c >= low) | (c == sentinel)


def within_sigma(df: DataFrame, column: str, k: float = 3.0, floor: float | None = 0.0) -> Column:
    """mean ± k sample deviations of ``df``; true for every row if the deviation is NULL, 0 or NaN."""
    mean, dev = F.avg(column), F.stddev_samp(column)
    low, high = mean - k * dev, mean + k * dev
    if floor is not None:
        low = F.greatest(F.lit(float(floor)), low)
    spread = dev.isNotNull() & ~F.isnan(dev) & (dev > 0)
    bounds = df.agg(
        F.when(spread, F.struct(low.alias("low"), high.alias("high"))).alias("bounds")
    ).scalar()
    return bounds.isNull() | F.col(column).between(bounds["low"], bounds["high"])


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Keep ``low`` ≤ x ≤ ``high``; NULL is dropped."""
    return df.filter(in_range(column, low, high))


def filter_min_or_sentinel(df: DataFrame, column: str, low: float, sentinel: float) -> DataFrame:
    """Keep x ≥ ``low`` and the sentinel."""
    return df.filter(at_least_or_sentinel(column, low, sentinel))


def filter_sigma(df: DataFrame, column: str, k: float = 3.0, floor: float | None = 0.0) -> DataFrame:
    """Keep values within ``k`` sample deviations of the mean, with the lower bound at ``floor`` or above."""
    return df.filter(within_sigma(df, column, k, floor))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Convert the named columns that exist; what does not convert becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip ASCII spaces at both ends of all string columns, or of the named ones that exist."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(F.col(c)) for c in columns if c in df.columns})
