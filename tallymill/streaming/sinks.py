"""Sinks and views of the telemetry streams. Every query has its own checkpoint folder and every
write can be repeated: a batch that runs again replaces what it wrote before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tallymill.operators.cleaning import dedupe_key, total_order
from tallymill.operators.telemetry import (
    distinct_readings,
    good_readings,
    latency,
    parse_readings,
    reading_key,
    readings_only,
    rejected,
    rolling_mean,
)

BATCH, UPTO = "batch_id", "upto"


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_append(
    df: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = (), once: bool = True
) -> StreamingQuery:
    """Append rows to Parquet files, exactly once. ``once`` stops when the input is used up."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", out)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _start(writer, checkpoint, once)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def start_upserts(
    df: DataFrame, out: str, checkpoint: str, keys: Sequence[str], once: bool = True, compact_every: int = 20
) -> StreamingQuery:
    """Write the groups that changed in each batch; ``current_rows`` shows the newest of each key.

    Every ``compact_every`` batches the newest row of each key goes into a snapshot, so that a
    reader has the last snapshot and the changes after it before it. The changes that went into the
    snapshot before the last are deleted; those of the last stay, for a batch that runs again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/changes/{BATCH}={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        newest = _newest(spark, out, keys, batch_id - 1)
        newest.write.mode("overwrite").parquet(f"{out}/snapshots/{UPTO}={batch_id}")
        last = batch_id - compact_every
        for old in range(max(last - compact_every + 1, 0), last + 1):
            _delete(spark, f"{out}/changes/{BATCH}={old}")
        _delete(spark, f"{out}/snapshots/{UPTO}={last - compact_every}")

    return _start(df.writeStream.outputMode("update").foreachBatch(write), checkpoint, once)


def _newest(spark: SparkSession, out: str, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """The newest row per key, from the last snapshot (of batch ``upto`` or before) and the changes after it."""
    changes = spark.read.parquet(f"{out}/changes")
    snapshots = _table(spark, f"{out}/snapshots")
    if snapshots is not None and upto is not None:
        snapshots = snapshots.filter(F.col(UPTO) <= upto)
    # both are partition columns: one number, and then only the folders that count
    last = snapshots.agg(F.max(UPTO)).first()[0] if snapshots is not None else None
    if last is not None:
        changes = changes.filter(F.col(BATCH) > last)
        old = snapshots.filter(F.col(UPTO) == last).drop(UPTO).withColumn(BATCH, F.lit(-1))
        changes = old.unionByName(changes)
    return dedupe_key(changes, keys, total_order(changes, [*keys, BATCH], [F.col(BATCH).desc()])).drop(BATCH)


def current_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of what ``start_upserts`` wrote."""
    return _newest(spark, out, keys)


def start_rejects(messages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Store the payloads that do not decode."""
    return start_append(rejected(parse_readings(messages)), out, checkpoint, once=once)


def start_late_rows(
    messages: DataFrame, out: str, checkpoint: str, delay_seconds: int, once: bool = True
) -> StreamingQuery:
    """Store readings that come more than ``delay_seconds`` behind the newest reading of earlier
    batches, the rows that stateful queries with that watermark skip without a word."""
    readings = readings_only(good_readings(parse_readings(messages)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        # what the batches before have seen is one number in the folder of the last one
        before = _table(spark, f"{out}/newest/{BATCH}={batch_id - 1}")
        seen = before.first()["newest"] if before is not None else None
        newest = batch.agg(F.greatest(F.max("timestamp"), F.lit(seen).cast("double")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{out}/newest/{BATCH}={batch_id}")
        limit = F.lit(None if seen is None else seen - float(delay_seconds)).cast("double")
        batch.filter(F.col("timestamp") <= limit).write.mode("overwrite").parquet(
            f"{out}/rows/{BATCH}={batch_id}"
        )
        _delete(spark, f"{out}/newest/{BATCH}={batch_id - 2}")
        batch.unpersist()

    return _start(readings.writeStream.outputMode("append").foreachBatch(write), checkpoint, once)


#: Order of messages as they arrive; ties are settled by what else tells them apart.
ARRIVAL = [("arrival_ts", "asc"), ("seq", "asc"), ("device_id", "asc"), ("ts", "asc")]


def start_latency(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    n: int = 500,
    once: bool = True,
    keys: Sequence[str] = (),
    copies_within: int = 3600,
) -> StreamingQuery:
    """Store each reading once, with the mean latency of it and the ``n - 1`` before it, per ``keys``, in
    order of arrival.

    A batch is joined by the last ``n`` readings before it (per key), which each batch leaves for the
    next. It also leaves which readings came in the last ``copies_within`` seconds, so that a copy
    that is delivered again in a later batch does not count; a copy that comes later than that may. State is ``n``
    rows per key and the keys of those seconds. Batches must come in the order of arrival, as a message queue's do.
    """
    readings = readings_only(good_readings(parse_readings(messages)))
    newest_first = [F.col(c).desc_nulls_first() for c, _ in ARRIVAL]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = latency(distinct_readings(batch))
        rows = rows.withColumn("__reading", reading_key(rows))
        seen = _table(spark, f"{out}/seen/{BATCH}={batch_id - 1}")
        if seen is not None:
            known = seen.select(F.col("device_id").alias("__device"), F.col("__reading").alias("__known"))
            same = F.col("device_id").eqNullSafe(F.col("__device")) & (F.col("__reading") == F.col("__known"))
            rows = rows.join(known, same, "left_anti")
        rows = rows.withColumn("fresh", F.lit(True))
        before = _table(spark, f"{out}/last/{BATCH}={batch_id - 1}")
        if before is not None:
            rows = rows.unionByName(before.withColumns({"fresh": F.lit(False), "__reading": F.lit(None).cast("string")}))
        rows.persist()
        readings_of = rows.drop("__reading")
        means = rolling_mean(readings_of, keys, ARRIVAL, "latency", "avg_latency", n=n)
        means.filter("fresh").drop("fresh").write.mode("overwrite").parquet(f"{out}/rows/{BATCH}={batch_id}")
        if keys:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
            newest = readings_of.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")
        else:
            newest = readings_of.orderBy(*newest_first).limit(n)
        newest.drop("fresh").write.mode("overwrite").parquet(f"{out}/last/{BATCH}={batch_id}")
        came = rows.filter("fresh").select("device_id", "__reading", "arrival_ts")
        came = came if seen is None else came.unionByName(seen)
        limit = F.col("__newest") - F.make_dt_interval(secs=F.lit(copies_within))
        came.withColumn("__newest", came.agg(F.max("arrival_ts")).scalar()).filter(
            F.col("__newest").isNull() | (F.col("arrival_ts") >= limit)
        ).drop("__newest").write.mode("overwrite").parquet(f"{out}/seen/{BATCH}={batch_id}")
        for state in ("last", "seen"):
            _delete(spark, f"{out}/{state}/{BATCH}={batch_id - 2}")
        rows.unpersist()

    return _start(readings.writeStream.outputMode("append").foreachBatch(write), checkpoint, once)


def latencies(spark: SparkSession, out: str) -> DataFrame:
    """What ``start_latency`` stored."""
    return spark.read.parquet(f"{out}/rows").drop(BATCH)


def last_readings(spark: SparkSession, out: str) -> DataFrame:
    """The last readings of the newest batch, for ``latency_summary`` and ``recent``."""
    last = spark.read.parquet(f"{out}/last")
    return last.filter(F.col(BATCH) == last.agg(F.max(BATCH)).scalar()).drop(BATCH)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """What ``start_late_rows`` stored."""
    return spark.read.parquet(f"{out}/rows").drop(BATCH)


def with_date(df: DataFrame) -> DataFrame:
    """Add the day of ``ts``, the partition column of the history table."""
    return df.withColumn("date", F.col("ts").cast("date"))
