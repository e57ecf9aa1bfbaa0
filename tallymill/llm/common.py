"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import ship_package

#: Rows that a Python task holds as Python objects at a time.
SLICE_ROWS = 512


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder; the workers get this package, if they lack it."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    """Arrow batches as {column: values}, few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pydict()


_forget: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Tell how to drop what an operator keeps in a Python worker between its tasks."""
    _forget[operator] = forget


def working(operator: str) -> None:
    """A task of ``operator`` begins: what others keep in this worker goes, as workers outlive a stage."""
    for other, forget in _forget.items():
        if other != operator:
            forget()


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the given columns; input columns of those names, in any case, make way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])
