"""Rows compared with averages of the table or of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.constants import ABOVE_AVERAGE, BELOW_AVERAGE
from tallymill.operators.grouping import group_stats
from tallymill.operators.joins import join_to_groups


def _average(df: DataFrame, column: str) -> Column:
    return df.agg(F.avg(column)).scalar()


def _finish(df: DataFrame, order: Sequence[Column], top: int | None, columns: Sequence[str] | None) -> DataFrame:
    df = df.orderBy(*order)
    if top is not None:
        df = df.limit(top)
    return df.select(*columns) if columns else df


def above_avg(
    df: DataFrame,
    column: str,
    order: Sequence[Column],
    where: Column | None = None,
    top: int | None = 10,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows above the mean of ``column`` over the whole table that also satisfy ``where``."""
    above = df.filter(F.col(column) > _average(df, column))
    if where is not None:
        above = above.filter(where)
    return _finish(above, order, top, columns)


def hidden_gems(
    df: DataFrame,
    score: str,
    votes: str,
    order: Sequence[Column],
    margin: float = 0.5,
    top: int | None = 10,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Score more than ``margin`` above its mean with fewer votes than the mean."""
    gems = df.filter(
        (F.col(score) > _average(df, score) + margin) & (F.col(votes) < _average(df, votes))
    )
    return _finish(gems, order, top, columns)


def vs_group_avg(
    df: DataFrame,
    key_name: str,
    key: Column,
    score: str,
    order: Sequence[Column],
    digits: int = 2,
    min_rows: int = 50,
    where: Column | None = None,
    groups_where: Column | None = None,
    top: int | None = 15,
    columns: Sequence[str] | None = None,
    small: int = 100_000,
) -> DataFrame:
    """Deviation of each row from the rounded mean of its group.

    Groups under ``min_rows`` rows drop out; ``where`` filters the compared rows only. Rows
    without a key have no group. Up to ``small`` groups are broadcast if their bytes allow it.
    """
    avg_name, size = f"{key_name}_avg_score", "__n"
    in_groups = key.isNotNull() if groups_where is None else key.isNotNull() & groups_where
    averages = group_stats(
        df,
        {key_name: key},
        {avg_name: ("avg", score, digits), size: ("count",)},
        where=in_groups,
        min_rows=min_rows,
    )
    # rows of no group, such as those of a frequent placeholder, must not reach a shuffle
    rows = df.filter(in_groups).withColumn(key_name, key)
    if where is not None:
        rows = rows.filter(where)
    gap = F.col(score) - F.col(avg_name)
    compared = join_to_groups(rows, averages, [key_name], size, small=small).withColumns(
        {
            "above_avg": F.round(gap, digits),
            "vs_avg": F.when(F.col(score) >= F.col(avg_name), ABOVE_AVERAGE).otherwise(BELOW_AVERAGE),
        }
    )
    return _finish(compared, order, top, columns)
