"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def main_value(column: Column | str, sep: str = "/") -> Column:
    """The part before the first ``sep``; NULL stays NULL and '' stays ''."""
    return F.substring_index(as_column(column), sep, 1)


def bucket(column: Column | str, lows: Sequence[tuple[object, str]], otherwise: str) -> Column:
    """Label of the first lower bound the value reaches; NULL gets ``otherwise``."""
    c = as_column(column)
    (low, label), *rest = lows
    case = F.when(c >= F.lit(low), F.lit(label))
    for low, label in rest:
        case = case.when(c >= F.lit(low), F.lit(label))
    return case.otherwise(F.lit(otherwise))


def decade_label(year: Column | str) -> Column:
    """1994 becomes '1990s'."""
    return F.concat((F.floor(as_column(year) / 10) * 10).cast("bigint").cast("string"), F.lit("s"))


def is_missing(name: str, data_type: T.DataType, text_nan: bool = False) -> Column:
    """NULL, or NaN for floating point. ``text_nan`` also counts the text 'NaN' in string columns."""
    c = F.col(f"`{name}`")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if text_nan and isinstance(data_type, T.StringType):
        return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))
    return c.isNull()


def round_to(column: Column, digits: int | None) -> Column:
    """Round half up, or leave the value alone for ``None``."""
    return column if digits is None else F.round(column, digits)


def timestamp_from_epoch(seconds: Column | str) -> Column:
    """UTC wall clock of an epoch-seconds number, to the microsecond, in any session time zone."""
    zero = F.lit(0)
    return F.expr(_EPOCH) + F.make_dt_interval(zero, zero, zero, as_column(seconds).cast("decimal(18,6)"))


def utc_clock(instant: Column) -> Column:
    """UTC wall clock of a TIMESTAMP, in any session time zone."""
    micros = F.unix_micros(instant)
    return timestamp_from_epoch(micros.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


def _interval_micros(interval: Column) -> Column:
    part = lambda unit: F.extract(F.lit(unit), interval)
    whole = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, independent of the session time zone."""
    return _interval_micros(as_column(ts) - F.expr(_EPOCH))


def seconds_between(end: Column | str, start: Column | str) -> Column:
    """``end - start`` in seconds as a double."""
    return _interval_micros(as_column(end) - as_column(start)) / 1_000_000
