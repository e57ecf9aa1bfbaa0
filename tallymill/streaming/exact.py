"""Streams that forget nothing: results kept as tables that batches add to, not as state in memory.

A batch writes what it adds under its own number, so a batch that runs again replaces its own rows
and never reads them. Every ``MERGE_EVERY`` batches the additions since the last merge are rewritten
as one; the additions that went into the merge before the last are deleted, those of the last stay
for a batch that runs again. Readers see the merged additions and the later ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymill.operators import metrics, telemetry
from tallymill.operators.cleaning import dedupe_key, total_order
from tallymill.streaming.sinks import BATCH, UPTO, _delete, _start, _table

MERGE_EVERY = 20
#: A batch with readings of more days reads the keys of all days.
MOST_DATES = 1000


def additions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What batches (those under ``before``) added to a table; None if nothing has been written yet."""
    merged, later = _table(spark, f"{path}/merged"), _table(spark, f"{path}/added")
    if merged is not None and before is not None:
        merged = merged.filter(F.col(UPTO) < before)
    # a partition column: one number, and then only the folders that count
    last = merged.agg(F.max(UPTO)).first()[0] if merged is not None else None
    if later is not None:
        later = later.filter(F.col(BATCH) > F.lit(-1 if last is None else last))
        later = (later if before is None else later.filter(F.col(BATCH) < before)).drop(BATCH)
    if last is None:
        return later
    return merged.drop(UPTO) if later is None else merged.drop(UPTO).unionByName(later)


def add(
    df: DataFrame,
    path: str,
    batch_id: int,
    partition_by: Sequence[str] = (),
    combine: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write what a batch adds; ``combine`` reduces the additions that are merged."""
    spark = df.sparkSession

    def write(rows: DataFrame, to: str) -> None:
        # few files: a day's rows go to one task, of which AQE splits those that are large
        placed = rows.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else rows
        placed.write.mode("overwrite").partitionBy(*partition_by).parquet(to)

    write(df, f"{path}/added/{BATCH}={batch_id}")
    if (batch_id + 1) % MERGE_EVERY:
        return
    first = batch_id - MERGE_EVERY + 1
    since = _table(spark, f"{path}/added")
    if since is not None:  # else all batches were empty
        since = since.filter(F.col(BATCH).between(first, batch_id)).drop(BATCH)
        write(combine(since) if combine else since, f"{path}/merged/{UPTO}={batch_id}")
    for old in range(max(first - MERGE_EVERY, 0), first):
        _delete(spark, f"{path}/added/{BATCH}={old}")


def _readings(messages: DataFrame) -> DataFrame:
    rows = telemetry.readings_only(telemetry.good_readings(telemetry.parse_readings(messages)))
    return rows.withColumns({"reading": telemetry.reading_key(rows), "date": F.col("ts").cast("date")})


def first_arrivals(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The readings of a batch that are not stored yet, each once.

    A reading sent again says the same, its time included, so only the stored days that occur in
    the batch are read, and of them the columns that tell readings apart.
    """
    keys = ["device_id", "ts", "reading"]
    order = [F.col("arrival_ts").asc_nulls_last(), F.col("topic").asc_nulls_last()]
    fresh = dedupe_key(batch, keys, total_order(batch, keys, order))
    if stored is None:
        return fresh
    days = [r.date for r in batch.select("date").distinct().limit(MOST_DATES + 1).collect()]
    if len(days) <= MOST_DATES:
        stored = stored.filter(F.col("date").isin(days))
    return fresh.join(stored.select("date", *keys), ["date", *keys], "left_anti")


def window_parts(readings: DataFrame, width: str) -> DataFrame:
    """Counts and sums per device and window, which may be added to those of other readings."""
    sums = [c for m in telemetry.METRICS for c in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"count_{m}"))]
    return (
        readings.groupBy("device_id", F.window("ts", width).getField("start").alias("window_start"))
        .agg(F.count(F.lit(1)).alias("readings"), *sums)
    )


def _add_up(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys])


_WINDOW = ("device_id", "window_start")


def start_readings(messages: DataFrame, out: str, checkpoint: str, width: str = "5 minutes", once: bool = True) -> StreamingQuery:
    """Store every reading once, however late it or a copy of it comes, and add it to its window.

    One query does both, so no reading can be in one and not in the other, and there is no watermark
    behind which any is lost. Nothing is kept in memory between batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        stored = additions(batch.sparkSession, f"{out}/readings", batch_id)
        add(first_arrivals(batch, stored), f"{out}/readings", batch_id, ["date"])
        batch.unpersist()
        # read back, as the next table must hold the same rows
        fresh = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/readings/added/{BATCH}={batch_id}")
        add(window_parts(fresh, width), f"{out}/windows", batch_id, combine=_add_up(_WINDOW))

    return _start(_readings(messages).writeStream.outputMode("append").foreachBatch(write), checkpoint, once)


def history(spark: SparkSession, out: str) -> DataFrame:
    """Readings with a temperature, each once."""
    return additions(spark, f"{out}/readings").filter(F.col("temperature").isNotNull()).drop("reading")


def windows(spark: SparkSession, out: str, width: str = "5 minutes") -> DataFrame:
    """Readings and means per device and window so far, as ``telemetry.windowed_readings`` has them."""
    total = _add_up(_WINDOW)(additions(spark, f"{out}/windows"))
    return total.select(
        *_WINDOW,
        (F.col("window_start") + F.expr(f"interval {width}")).alias("window_end"),
        "readings",
        *[F.try_divide(f"sum_{m}", f"count_{m}").alias(f"avg_{m}") for m in telemetry.METRICS],
    )


def start_counter_rates(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    series: Sequence[str],
    width: str = "5 minutes",
    where: Column | None = None,
    tie: str | None = None,
    chunk: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Add the increases of counters to their windows, batch by batch.

    The last sample of each series is carried to the next batch, so the pair across the border counts.
    State is one row per series, on disk. A sample that is not behind the last of its series in an
    earlier batch, a copy of it for one, can no longer be paired; it is stored in ``<out>/late``.
    """
    chosen = samples if where is None else samples.filter(where)
    position = F.struct("ts", *([tie] if tie else []))
    names = chosen.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        last = _table(spark, f"{out}/last/{BATCH}={batch_id - 1}")
        if last is not None:
            same = F.lit(True)
            for c in series:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            at = last.select(*[F.col(c).alias(f"__{c}") for c in series], position.alias("__last"))
            joined = batch.join(at, same, "left")
            late = F.col("__last").isNotNull() & (position <= F.col("__last"))
            joined.filter(late).select(*names).write.mode("overwrite").parquet(f"{out}/late/{BATCH}={batch_id}")
            rows = joined.filter(~late).select(*names).unionByName(last)
        rows.persist()
        increases = metrics.counter_increase(rows, series, width, tie=tie, chunk=chunk)
        # a series that only brought its last sample along adds nothing
        changed = increases.filter((F.col("seconds") > 0) | (F.col("increase") != 0))
        add(changed, f"{out}/increases", batch_id, combine=_add_up([*series, "window_start"]))
        newest = rows.groupBy(*series).agg(F.max_by(F.struct(*names), position).alias("__row"))
        newest.select("__row.*").write.mode("overwrite").parquet(f"{out}/last/{BATCH}={batch_id}")
        rows.unpersist()
        _delete(spark, f"{out}/last/{BATCH}={batch_id - 2}")

    return _start(chosen.writeStream.outputMode("append").foreachBatch(write), checkpoint, once)


def counter_rates(spark: SparkSession, out: str, series: Sequence[str]) -> DataFrame:
    """Rates per series and window so far, as ``metrics.counter_rate`` has them."""
    return metrics.with_rate(_add_up([*series, "window_start"])(additions(spark, f"{out}/increases")))
