"""Column profiles. Each is one pass over the data, however many columns it reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.columns import is_missing


def missing_counts(df: DataFrame, text_nan: bool = False) -> DataFrame:
    """One row: per column the number of NULL or NaN values."""
    return df.agg(
        *[
            F.count_if(is_missing(f.name, f.dataType, text_nan)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def missing_rates(df: DataFrame, text_nan: bool = False) -> DataFrame:
    """One row: per column the missing values in percent; NULL for an empty table."""
    total = F.count(F.lit(1))
    return df.agg(
        *[
            F.try_divide(F.count_if(is_missing(f.name, f.dataType, text_nan)) * 100.0, total).alias(f.name)
            for f in df.schema.fields
        ]
    )


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, sample standard deviation, minimum and maximum of a column."""
    c = F.col(column)
    return df.agg(
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def describe_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, numbers and texts: count, mean, stddev, min and max as numbers, and for
    texts first and last in order (NULL for numbers, as the numbers are for texts).

    All columns are aggregated in one pass into one row, which is then turned into rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns or [n for n, t in types.items() if isinstance(t, (T.NumericType, T.StringType))])

    def number(name: str, value: Column) -> Column:
        return value.cast("double") if isinstance(types[name], T.NumericType) else F.lit(None).cast("double")

    def text(name: str, value: Column) -> Column:
        return value if isinstance(types[name], T.StringType) else F.lit(None).cast("string")

    profile = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.count(n).alias("count"),
                number(n, F.avg(F.lit(None) if isinstance(types[n], T.StringType) else F.col(n))).alias("mean"),
                number(n, F.stddev_samp(F.lit(None) if isinstance(types[n], T.StringType) else F.col(n))).alias("stddev"),
                number(n, F.min(n)).alias("min"),
                number(n, F.max(n)).alias("max"),
                text(n, F.min(n)).alias("first"),
                text(n, F.max(n)).alias("last"),
            )
            for n in names
        ]
    )
    return df.agg(profile.alias("p")).select(F.inline("p"))


def schema_report(df: DataFrame) -> DataFrame:
    """Column names, types and nullability as a small table."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")
