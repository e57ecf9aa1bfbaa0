"""Aggregate measures: (function, column, digits)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.columns import as_column, round_to


class Measure(NamedTuple):
    """One output of an aggregate: ``func`` is count, sum, avg, min, max or stddev."""

    func: str
    column: Column | str = "*"
    digits: int | None = None


_FUNCTIONS = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
}


def count_rows() -> Measure:
    return Measure("count")


def measure_column(name: str, measure: Measure | tuple) -> Column:
    func, column, digits = Measure(*measure)
    if isinstance(column, str) and column == "*":
        return F.count(F.lit(1)).alias(name)
    return round_to(_FUNCTIONS[func](as_column(column)), digits).alias(name)
