"""Splitting an ordered column into chunks of bounded size.

A window over one key, or over the whole table, runs in one task per group. When a group may
hold a large part of the data, the operators here cut it along its order into chunks, work on
the chunks in parallel and add per-chunk offsets. Chunk borders are quantiles of the column.
They only balance the work: results are exact for any borders, since the borders become
constants of the plan and every task, and every retry of a task, sees the same ones.

Quantiles are doubles, which cannot tell all integers and decimals apart. A border is therefore
turned into a value of the column's own type, and rows are compared with that one: the chunk of a
border holds this value and no other. Borders of text are texts of a bounded sample of the rows, found by
binary search; they may be cut short, as any text is a border.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.columns import epoch_micros

Order = Sequence[tuple[str, str]]


#: Rows of a chunk, about, where that needs more chunks than the session has shuffle partitions.
CHUNK_ROWS = 4_000_000
#: Texts looked at for borders, and characters of each.
SAMPLE_TEXTS = 20_000
BORDER_LENGTH = 256


def default_parts(df: DataFrame) -> int:
    """As many chunks as the session has shuffle partitions, and enough for ``CHUNK_ROWS`` each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(parts, 8, math.ceil(df.count() / CHUNK_ROWS))


def position_on_line(df: DataFrame, column: str) -> Column | None:
    """The column as a number, or text, that keeps its order exactly, or None where there is none."""
    data_type = df.schema[column].dataType
    c = F.col(column)
    if isinstance(data_type, T.FloatType):
        return c.cast("double")
    if isinstance(data_type, (T.DecimalType, T.DoubleType)):
        return c
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return c.cast("bigint")
    if isinstance(data_type, T.TimestampNTZType):
        return epoch_micros(c)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(data_type, T.StringType):
        return c
    return None


def _own_value(border: float, kind: T.DataType) -> Column:
    """A border as a value of the line's type, clipped to its range."""
    if isinstance(kind, T.DecimalType):
        most = decimal.Decimal(10) ** (kind.precision - kind.scale) - decimal.Decimal(10) ** -kind.scale
        exact = min(max(decimal.Decimal(border), -most), most)
        with decimal.localcontext(prec=80):
            return F.lit(str(exact.quantize(decimal.Decimal(10) ** -kind.scale, decimal.ROUND_FLOOR))).cast(kind)
    if isinstance(kind, T.LongType):
        return F.lit(min(max(math.floor(border), -(1 << 63)), (1 << 63) - 1)).cast("bigint")
    return F.lit(border)


def borders(df: DataFrame, lines: dict[str, Column], parts: int) -> dict[str, list[float] | list[str]]:
    """Approximate quantiles of each column's line, at most ``parts - 1`` values per column.

    These are the small jobs that run when the plan is built.
    """
    probabilities = [i / parts for i in range(1, parts)]
    if not probabilities or not lines:
        return {name: [] for name in lines}
    texts = [name for name in lines if isinstance(df.schema[name].dataType, T.StringType)]
    numbers = {name: c.cast("double") for name, c in lines.items() if name not in texts}
    out: dict[str, list[float] | list[str]] = {name: _text_borders(df, name, parts) for name in texts}
    if numbers:
        found = df.select(*[c.alias(name) for name, c in numbers.items()]).approxQuantile(list(numbers), probabilities, 1 / (4 * parts))
        out |= {name: sorted({v for v in values if math.isfinite(v)}) for name, values in zip(numbers, found, strict=True)}
    return out


def _text_borders(df: DataFrame, name: str, parts: int) -> list[str]:
    """Quantiles of a random sample of at most ``SAMPLE_TEXTS`` rows, in the order of their bytes."""
    rows = df.where(F.col(name).isNotNull()).select(F.substring(name, 1, BORDER_LENGTH).alias("text"))
    sample = sorted((r["text"] for r in rows.orderBy(F.rand(parts)).limit(min(SAMPLE_TEXTS, 100 * parts)).collect()), key=str.encode)
    return sorted({sample[i * len(sample) // parts] for i in range(1, parts)}, key=str.encode) if sample else []


def _borders_upto(text: Column, cuts: Sequence[str]) -> Column:
    """How many of the sorted ``cuts`` are not above the text."""
    every = F.array(*map(F.lit, cuts))

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        higher = F.struct((middle + 1).alias("low"), at["high"].alias("high"))
        lower = F.struct(at["low"].alias("low"), middle.alias("high"))
        return F.when(at["low"] >= at["high"], at).when(F.get(every, middle) <= text, higher).otherwise(lower)

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, begin, step, lambda at: at["low"])


def add_chunk(df: DataFrame, line: Column, cuts: Sequence[float] | Sequence[str], out: str) -> DataFrame:
    """Number the chunks in the order of ``line``; NULL gives NULL, NaN the last chunk.

    Every border is a chunk of its own (an odd number), so that a value with very many copies
    is never mixed with other values; the open intervals between borders are the even numbers.
    """
    own, raw, below = "__own", "__line", "__below"
    df = df.withColumn(own, line)
    if not cuts:
        return df.withColumn(out, F.when(F.col(own).isNotNull(), F.lit(0))).drop(own)
    if isinstance(cuts[0], str):
        df = df.withColumn(below, F.when(F.col(own).isNotNull(), _borders_upto(F.col(own), cuts)))
        n = F.col(below)
        at_border = F.coalesce(F.get(F.array(*map(F.lit, cuts)), n - 1) == F.col(own), F.lit(False))
        return df.withColumn(out, 2 * n - at_border.cast("int")).drop(own, below)
    df = df.withColumn(raw, F.col(own).cast("double"))
    kind = df.schema[own].dataType
    splits = [-math.inf, *cuts, math.inf]
    stage = Bucketizer(splits=splits, inputCol=raw, outputCol=below, handleInvalid="keep")
    n = F.col(below).cast("int")
    border = F.get(F.array(*[_own_value(v, kind) for v in cuts]), n - 1)
    # as doubles the row is at or above its border; by its own type it may be the border or below
    back = F.when(n == 0, 0).when(F.col(own) == border, 1).when(F.col(own) < border, 2).otherwise(0)
    chunk = F.when(F.isnan(raw), 2 * len(cuts) + 2).otherwise(2 * n - back)
    return stage.transform(df).withColumn(out, chunk).drop(own, raw, below)


def add_order_chunks(
    df: DataFrame, order: Order, out: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Add two chunk columns that rise along ``order``: [(column, "asc" or "desc"), …], NULLs last.

    The second splits the single-value chunks of the first by the second column of ``order``,
    usually the tie-breaker, so that even one value shared by a third of all rows is divided.
    """
    parts = parts or default_parts(df)
    first, second = out
    used = [(name, way) for name, way in order[:2]]
    lines = {name: position_on_line(df, name) for name, _ in used}
    cuts = borders(df, {n: c for n, c in lines.items() if c is not None}, parts)

    def signed(column: Column, way: str, size: int) -> Column:
        ordered = -column if way == "desc" else column
        return F.coalesce(ordered, F.lit(2 * size + 3))

    name, way = used[0]
    if lines[name] is None:
        return df.withColumns({first: F.lit(0), second: F.lit(0)})
    df = add_chunk(df, lines[name], cuts[name], first)
    single = F.col(first).isNull() | (F.col(first) % 2 == 1)
    if len(used) > 1 and lines[used[1][0]] is not None:
        name2, way2 = used[1]
        df = add_chunk(df, lines[name2], cuts[name2], second)
        df = df.withColumn(second, F.when(single, signed(F.col(second), way2, len(cuts[name2]))).otherwise(0))
    else:
        df = df.withColumn(second, F.lit(0))
    return df.withColumn(first, signed(F.col(first), way, len(cuts[name])))


def sort_columns(order: Order) -> list[Column]:
    """``order`` as sort columns with NULLs last."""
    return [
        F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()
        for name, way in order
    ]
