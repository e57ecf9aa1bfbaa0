"""Joins of a large table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import write_once


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns in which NULL equals NULL; the keys appear once."""
    right = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, condition, how).drop(*[f"__r_{k}" for k in keys])


def join_to_groups(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    small: int = 100_000,
    small_bytes: int = 64 * 1024 * 1024,
    hot_share: int = 1000,
) -> DataFrame:
    """Join rows with the one row of their group, whatever share of the rows a group holds.

    ``groups`` is written once to the shared folder and measured there. Up to ``small`` groups of
    ``small_bytes`` together are broadcast, so the rows are not shuffled at all. Otherwise only the groups with more than
    1 in ``hot_share`` of all rows (at most ``hot_share`` of them) are, and the rows of all other
    groups go through a shuffled join in which no key is large. ``size`` is the column of
    ``groups`` that holds the number of rows; it is dropped.
    """
    groups = write_once(groups, "groups")
    written = F.octet_length(F.to_json(F.struct(*groups.columns)))
    counted, total, length = groups.agg(F.count(F.lit(1)), F.sum(size), F.sum(written)).first()
    if counted <= small and (length or 0) <= small_bytes:
        return join_null_safe(df, F.broadcast(groups.drop(size)), keys)
    is_hot = F.col(size) * hot_share > total
    hot = F.broadcast(groups.filter(is_hot).drop(size))
    rest = groups.filter(~is_hot).drop(size)
    cold_rows = join_null_safe(df, hot.select(*keys), keys, "left_anti")
    return join_null_safe(df, hot, keys).unionByName(join_null_safe(cold_rows, rest, keys))
