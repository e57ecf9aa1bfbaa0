"""The telemetry operators as streams. Each starts one query on a stream of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymill.operators import telemetry
from tallymill.streaming import sinks


def readings_stream(messages: DataFrame, delay: str) -> DataFrame:
    """Decoded readings with ``event_time`` (an instant, as watermarks need one) and a watermark
    ``delay`` behind the newest."""
    parsed = telemetry.good_readings(telemetry.parse_readings(messages))
    # good readings have times of the years 1 to 9999, so the number fits
    micros = F.round(F.col("timestamp") * 1_000_000).cast("bigint")
    timed = telemetry.readings_only(parsed).withColumn("event_time", F.timestamp_micros(micros))
    return timed.withWatermark("event_time", delay)


def once_each(readings: DataFrame) -> DataFrame:
    """One message per reading, however often and on however many topics it came within the watermark."""
    keyed = readings.withColumn("__reading", telemetry.reading_key(readings))
    return keyed.dropDuplicatesWithinWatermark(["device_id", "__reading"]).drop("__reading")


def start_with_late_rows(
    start: Callable[..., StreamingQuery], messages: DataFrame, out: str, checkpoint: str, delay_seconds: int, **options: object
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start a job that has a watermark, and beside it the one that stores what the watermark makes
    it skip, in ``<out>-late``.

    Lateness is judged by batches. Two queries that run on and cut their batches differently may
    differ on a reading close to the watermark; ``exact.start_readings`` is one query and has no
    watermark.
    """
    job = start(messages, out, checkpoint, delay=f"{delay_seconds} seconds", **options)
    late = sinks.start_late_rows(messages, f"{out}-late", f"{checkpoint}-late", delay_seconds, options.get("once", True))
    return job, late


def start_latest(messages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Latest values per device. State: one row per device."""
    parsed = telemetry.good_readings(telemetry.parse_readings(messages))
    latest = telemetry.latest_by_device(telemetry.readings_only(parsed))
    return sinks.start_upserts(latest, out, checkpoint, ["device_id"], once)


def latest(spark: SparkSession, out: str) -> DataFrame:
    return sinks.current_rows(spark, out, ["device_id"])


def start_slots(
    messages: DataFrame, out: str, checkpoint: str, ttl: str = "1 hour", delay: str = "10 minutes", once: bool = True
) -> StreamingQuery:
    """Slots for expiring values. State: one row per device and slot newer than the watermark."""
    slots = telemetry.ttl_slots(readings_stream(messages, delay), ttl, time="event_time")
    return sinks.start_upserts(slots, out, checkpoint, ["device_id", "slot_start"], once)


def unexpired(spark: SparkSession, out: str, now: Column, ttl: str = "1 hour") -> DataFrame:
    """Values of the slots that have not expired at ``now``."""
    slots = sinks.current_rows(spark, out, ["device_id", "slot_start"])
    return telemetry.alive_values(slots, now, ttl)


def start_history(
    messages: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", once: bool = True
) -> StreamingQuery:
    """Readings with a temperature, each once, in Parquet by date. State: keys within ``delay``."""
    readings = readings_stream(messages, delay)
    single = once_each(readings.filter(readings.temperature.isNotNull()))
    return sinks.start_append(sinks.with_date(single), out, checkpoint, ["date"], once)


def start_windows(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    width: str = "5 minutes",
    delay: str = "10 minutes",
    once: bool = True,
) -> StreamingQuery:
    """Means per device and window, each reading once; a window is updated until the watermark
    passes its end. State: keys within ``delay`` and open windows."""
    windows = telemetry.windowed_readings(once_each(readings_stream(messages, delay)), width, time="event_time")
    return sinks.start_upserts(windows, out, checkpoint, ["device_id", "window_start"], once)


def windows(spark: SparkSession, out: str) -> DataFrame:
    return sinks.current_rows(spark, out, ["device_id", "window_start"])


def start_sessions(
    messages: DataFrame, out: str, checkpoint: str, ttl: str = "1 hour", delay: str = "10 minutes", once: bool = True
) -> StreamingQuery:
    """Store each stretch of a device's readings once no reading within ``ttl`` can follow it any more.
    State: keys within ``delay`` and the stretches that are still open."""
    sessions = telemetry.sessions(once_each(readings_stream(messages, delay)), ttl, time="event_time")
    return sinks.start_append(sessions, out, checkpoint, once=once)


def start_status(messages: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Last status per device by arrival. State: one row per device."""
    parsed = telemetry.good_readings(telemetry.parse_readings(messages))
    return sinks.start_upserts(telemetry.device_status(parsed), out, checkpoint, ["device_id"], once)


def status(spark: SparkSession, out: str) -> DataFrame:
    return sinks.current_rows(spark, out, ["device_id"])
