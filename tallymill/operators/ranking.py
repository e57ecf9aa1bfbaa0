"""Ranks within groups and over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.chunking import (
    Order,
    add_chunk,
    add_order_chunks,
    borders,
    default_parts,
    position_on_line,
    sort_columns,
)
from tallymill.operators.joins import join_null_safe
from tallymill.session import write_once


def rank_columns(df: DataFrame, keys: Sequence[str], ranks: dict[str, tuple[Column, Sequence[Column]]]) -> DataFrame:
    """Add window rank functions, each with its own order, over one partitioning (one shuffle).

    For groups of moderate size; ``top_n_per_group``, ``row_numbers`` and ``percent_rank_global``
    are the forms for groups of any size.
    """
    return df.withColumns(
        {
            name: function.over(Window.partitionBy(*keys).orderBy(*order))
            for name, (function, order) in ranks.items()
        }
    )


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    unique: Sequence[Column],
    row_number: str = "rn",
    rank: str | None = None,
    percent_rank: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` and then ``unique``, with their ranks.

    ``rank`` and ``percent_rank`` name columns that rank by ``order`` alone among *all* rows of
    the group. Rows strictly ahead of a kept row are themselves kept, so ranking the kept rows
    gives the same number, and the group size comes from a pre-aggregated count: no task ever
    sorts a whole group.
    """
    numbered = Window.partitionBy(*keys).orderBy(*order, *unique)
    best = df.withColumn(row_number, F.row_number().over(numbered)).filter(F.col(row_number) <= n)
    if rank or percent_rank:
        rank_name = rank or "__rank"
        best = best.withColumn(rank_name, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))
    if percent_rank:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
        best = join_null_safe(best, sizes, keys).withColumn(
            percent_rank, _percent(F.col(rank_name) - 1, F.col("__size"), digits)
        )
        best = best.drop("__size", "__rank")
    return best


def _percent(ahead: Column, size: Column, digits: int | None) -> Column:
    share = F.when(size > 1, ahead / (size - 1)).otherwise(F.lit(0.0))
    return share if digits is None else F.round(share, digits)


#: Rows of a group that one task numbers without more ado.
SMALL_GROUP = 100_000


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Order, out: str = "rn", parts: int | None = None
) -> DataFrame:
    """ROW_NUMBER for every row of every group, NULLs last, where a group may be any size.

    ``order`` is [(column, "asc" or "desc"), …] and should end in a unique column. A group of more
    than ``SMALL_GROUP`` rows (any group, if ``parts`` is given) is cut along the order into chunks; a row's
    number is its place in the chunk plus the rows in earlier chunks. These come from pre-aggregated counts,
    added up in two levels, so that no window over counts is longer than the borders of one column.
    """
    chunk = ["__c1", "__c2"]
    large = None
    if parts is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > SMALL_GROUP)
        large = write_once(sizes.withColumn("__large", F.lit(True)).drop("__size"), "large-groups")
        if large.isEmpty():
            number = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order)))
            return df.withColumn(out, number.cast("bigint"))
    cut = add_order_chunks(df, order, chunk, parts)
    if keys and large is not None:
        cut = join_null_safe(cut, large, keys, "left")
        cut = cut.withColumns({c: F.when(F.col("__large"), F.col(c)).otherwise(0) for c in chunk}).drop("__large")
    ids = [*keys, *chunk]
    before = (Window.unboundedPreceding, -1)
    headers = cut.groupBy(*ids).agg(F.count(F.lit(1)).alias("__size"))
    inside = Window.partitionBy(*keys, chunk[0]).orderBy(chunk[1]).rowsBetween(*before)
    earlier = Window.partitionBy(*keys).orderBy(chunk[0]).rowsBetween(*before)
    outer = headers.groupBy(*keys, chunk[0]).agg(F.sum("__size").alias("__size"))
    outer = outer.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    headers = join_null_safe(headers, outer, [*keys, chunk[0]])
    headers = headers.withColumn("__offset", F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    headers = headers.drop("__size", "__before")
    # The offset travels as the first row of its chunk: one shuffle, no join, NULL keys included.
    rows = cut.withColumn("__offset", F.lit(None).cast("bigint"))
    within = Window.partitionBy(*ids).orderBy(F.col("__offset").asc_nulls_last(), *sort_columns(order))
    numbered = rows.unionByName(headers, allowMissingColumns=True).withColumns(
        {
            "__first": F.max("__offset").over(within.rowsBetween(Window.unboundedPreceding, 0)),
            out: F.row_number().over(within),
        }
    )
    return (
        numbered.filter(F.col("__offset").isNull())
        .withColumn(out, F.col("__first") + F.col(out) - 1)
        .drop("__offset", "__first", *chunk)
    )


def percent_rank_top(
    df: DataFrame, order: Sequence[Column], unique: Sequence[Column], k: int, out: str, digits: int | None = None
) -> DataFrame:
    """The first ``k`` rows of the table with their PERCENT_RANK by ``order`` among all rows.

    The ranking window sees ``k`` rows; the table is only counted and searched for its top.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    best = df.orderBy(*order, *unique).limit(k)
    ranked = best.withColumn("__rank", F.rank().over(Window.orderBy(*order)))
    return ranked.withColumn(out, _percent(F.col("__rank") - 1, total, digits)).drop("__rank")


def percent_rank_global(
    df: DataFrame,
    column: str,
    desc: bool = True,
    out: str = "percentile",
    digits: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """PERCENT_RANK of every row over the whole table, NULLs last, without one big partition.

    The value range is cut into chunks; the rank is the rank inside the chunk plus the rows of
    earlier chunks. A value with very many copies is alone in its chunk, where every row has rank
    1, so such a chunk may be split anywhere: it is split by the task its rows come from.
    """
    parts = parts or default_parts(df)
    line = position_on_line(df, column)
    if line is None:
        raise ValueError(f"percent_rank_global can't order {column}")
    cuts = borders(df, {column: line}, parts)[column]
    nan_chunk, null_chunk = 2 * len(cuts) + 2, 2 * len(cuts) + 3

    cut = add_chunk(df, line, cuts, "__c")
    one_value = F.col("__c").isNull() | (F.col("__c") % 2 == 1) | (F.col("__c") == nan_chunk)
    split = F.when(one_value, F.pmod(F.spark_partition_id(), F.lit(parts))).otherwise(0)
    chunk = F.coalesce(-F.col("__c") if desc else F.col("__c"), F.lit(null_chunk))
    cut = cut.withColumns({"__split": split, "__chunk": chunk}).drop("__c")

    # One row per chunk, at most 2 * parts + 3 rows: a single task and a broadcast are fine here.
    everywhere = Window.orderBy("__chunk")
    shifts = (
        cut.groupBy("__chunk")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            "__chunk",
            (F.sum("__rows").over(everywhere) - F.col("__rows")).alias("__shift"),
            F.sum("__rows").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
        )
    )
    value = sort_columns([(column, "desc" if desc else "asc")])
    inside = F.rank().over(Window.partitionBy("__chunk", "__split").orderBy(*value)) - 1
    ranked = cut.join(F.broadcast(shifts), "__chunk").withColumn(
        out, _percent(inside + F.col("__shift"), F.col("__total"), digits)
    )
    return ranked.select(*df.columns, out)
