"""Sensor telemetry. Readings carry device_id, seq, ts (UTC wall clock) and their metrics.

Functions marked *stream* work unchanged on a streaming DataFrame; the others need the whole
history and run on batch tables (or inside ``foreachBatch``).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions.columns import (
    as_column,
    epoch_micros,
    round_to,
    seconds_between,
    timestamp_from_epoch,
    utc_clock,
)
from tallymill.functions.constants import TOPICS, UNKNOWN_DEVICE
from tallymill.operators.chunking import Order
from tallymill.operators.cleaning import dedupe_key, total_order
from tallymill.operators.ranking import row_numbers

READING_SCHEMA = (
    "device_id string, device string, timestamp double, temperature double, humidity double, "
    "unit_temp string, unit_humid string, seq bigint, status string"
)
METRICS = ("temperature", "humidity")
#: Epoch seconds of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800.0, 253_402_300_799.0


def parse_readings(
    raw: DataFrame, schema: str = READING_SCHEMA, value: str = "value", bad: str = "bad_payload"
) -> DataFrame:
    """Decode the JSON in ``value`` into columns and ``ts``. *stream*

    Missing fields get their defaults: the device is ``device_id``, else ``device``, else
    'unknown'; the timestamp is 0. ``bad`` holds the text of a payload that is not JSON, has a
    field of the wrong type or a time that no calendar has (``ts`` is NULL then), or carries no
    metric, status or sequence number; it is NULL for a good one. A NULL payload is bad as ''.
    """
    options = {"columnNameOfCorruptRecord": bad}
    parsed = raw.withColumn("__p", F.from_json(value, f"{schema}, {bad} string", options))
    timestamp = F.coalesce(F.col("__p.timestamp"), F.lit(0.0))
    names = [f.name for f in parsed.schema["__p"].dataType.fields]
    rest = [n for n in names if n not in ("device_id", "device", "timestamp", bad)]
    # NaN is above every number
    has_time = timestamp.between(FIRST_SECOND, LAST_SECOND)
    content = [F.col(f"__p.{n}").isNotNull() for n in rest if n in (*METRICS, "status", "seq")]
    broken = F.col("__p").isNull() | F.col(f"__p.{bad}").isNotNull()
    useless = ~has_time | ~functools.reduce(operator.or_, content, F.lit(not content))
    return parsed.select(
        *[c for c in raw.columns if c != value],
        F.coalesce("__p.device_id", "__p.device", F.lit(UNKNOWN_DEVICE)).alias("device_id"),
        timestamp.alias("timestamp"),
        timestamp_from_epoch(F.when(has_time, timestamp)).alias("ts"),
        *[F.col(f"__p.{n}").alias(n) for n in rest],
        F.when(broken | useless, F.coalesce(F.col(value), F.lit(""))).alias(bad),
    )


def good_readings(parsed: DataFrame, bad: str = "bad_payload") -> DataFrame:
    """Payloads that decoded. *stream*"""
    return parsed.filter(F.col(bad).isNull()).drop(bad)


def rejected(parsed: DataFrame, bad: str = "bad_payload") -> DataFrame:
    """Payloads that did not decode. *stream*"""
    return parsed.filter(F.col(bad).isNotNull()).select(
        *[c for c in ("topic", "arrival_ts") if c in parsed.columns], F.col(bad).alias("value")
    )


def readings_only(parsed: DataFrame) -> DataFrame:
    """Messages with a sequence number or a metric; status messages have neither. *stream*"""
    carries = [F.col(c).isNotNull() for c in ("seq", *METRICS) if c in parsed.columns]
    return parsed.filter(functools.reduce(operator.or_, carries))


def reading_key(df: DataFrame) -> Column:
    """What tells readings of one device apart: the sequence number, or what the reading says if
    it has none. *stream*"""
    says = F.to_json(F.struct(*[c for c in ("ts", *METRICS) if c in df.columns]))
    return F.coalesce(F.concat(F.lit("#"), F.col("seq").cast("string")), says)


def topic_filter(df: DataFrame, topics: Sequence[str] = TOPICS) -> DataFrame:
    """Messages of the subscribed topics. *stream*"""
    return df.filter(F.col("topic").isin(*topics))


def latency(df: DataFrame, arrival: str = "arrival_ts", sent: str = "ts", digits: int = 1) -> DataFrame:
    """Seconds from sending to arrival, and rounded milliseconds. *stream*"""
    seconds = seconds_between(arrival, sent)
    return df.withColumns({"latency": seconds, "latency_ms": F.round(seconds * 1000, digits)})


def distinct_readings(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One message per reading (``reading_key``): publishers send a reading on several topics and
    may send it again. The earliest arrival stays; ties are decided by all other columns."""
    keys = ["device_id", "__reading"]
    order = order or [F.col("arrival_ts").asc_nulls_last(), F.col("topic").asc_nulls_last()]
    keyed = df.withColumn("__reading", reading_key(df))
    return dedupe_key(keyed, keys, total_order(keyed, keys, order)).drop("__reading")


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    column: str,
    out: str,
    n: int = 500,
    digits: int | None = None,
    parts: int | None = None,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Mean of ``column`` over the row and its ``n - 1`` predecessors in the same group.

    Rows are numbered per group without sorting a group in one task, then cut into blocks of about
    ``block_rows``. The last ``n - 1`` rows of a block are copied into the next one as context,
    so every block is complete by itself and no task needs more than one block.

    Inside a block the rows form segments of ``n``. The last ``n`` values before any row are the
    head of its own segment and the tail of the segment before, so two running sums replace
    ``n`` additions per row, and only values inside the frame are ever added up.
    """
    place, block, segment = "__place", "__block", "__segment"
    block_rows = max(block_rows // n, 1) * n
    rows = row_numbers(df, keys, order, place, parts)
    at = F.col(place) - 1
    own = F.struct(F.floor(at / block_rows).alias("b"), F.lit(False).alias("context"))
    ahead = F.struct((own["b"] + 1).alias("b"), F.lit(True).alias("context"))
    is_tail = F.pmod(at, F.lit(block_rows)) > block_rows - n
    copies = F.explode(F.when(is_tail, F.array(own, ahead)).otherwise(F.array(own)))
    cut = (
        rows.withColumn("__copy", copies)
        .withColumns(
            {block: F.col("__copy.b"), "__context": F.col("__copy.context"), segment: F.floor(at / n)}
        )
        .drop("__copy")
        .repartition(*keys, block)
    )
    in_segment = Window.partitionBy(*keys, block, segment)
    head = in_segment.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    tail = in_segment.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
    in_block = Window.partitionBy(*keys, block).orderBy(segment, place)

    def frame_total(name: str) -> Column:
        ends_segment = F.pmod(at, F.lit(n)) == n - 1
        before = F.lag(f"__tail_{name}", n - 1).over(in_block)
        return F.col(f"__head_{name}") + F.when(ends_segment, 0).otherwise(F.coalesce(before, F.lit(0)))

    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    sums = {"sum": F.sum(value), "count": F.count(column)}
    cut = cut.withColumns({f"__tail_{k}": f.over(tail) for k, f in sums.items()})
    cut = cut.withColumns({f"__head_{k}": f.over(head) for k, f in sums.items()})
    cut = cut.withColumns({f"__{k}": frame_total(k) for k in sums})
    mean = F.when(F.col("__count") > 0, F.col("__sum") / F.col("__count"))
    kept = cut.filter(~F.col("__context")).withColumn(out, round_to(mean, digits))
    return kept.select(*df.columns, out)


def latency_summary(
    df: DataFrame,
    order: Sequence[Column],
    n: int = 500,
    column: str = "latency",
    digits: int = 1,
) -> DataFrame:
    """One row over the last ``n`` messages: samples, mean, maximum and minimum in ms."""
    last = df.orderBy(*order).limit(n).select(column)
    ms = F.col(column) * 1000
    return last.agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg(ms), digits).alias("avg_ms"),
        F.round(F.max(ms), digits).alias("max_ms"),
        F.round(F.min(ms), digits).alias("min_ms"),
    )


def event_order(ts: str = "ts", seq: str = "seq") -> Column:
    """(ts, seq) as one number, so that aggregates ordered by it can hash instead of sort.

    Microseconds take the upper 19 digits, the sequence number (0 if missing) the lower 19.
    """
    shift = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    number = F.coalesce(F.col(seq), F.lit(0)).cast("decimal(19,0)")
    return epoch_micros(ts).cast("decimal(19,0)") * shift + number


def _latest_of(metric: str, position: str) -> Column:
    return F.max_by(metric, F.when(F.col(metric).isNotNull(), F.col(position)))


def latest_by_device(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per device the last value of each metric by (ts, seq), and the time it was last seen.
    A reading without a metric does not overwrite the metric's value. *stream* (update mode)"""
    positioned = df.withColumn("__at", event_order())
    return positioned.groupBy("device_id").agg(
        *[_latest_of(m, "__at").alias(m) for m in metrics], F.max("ts").alias("last_seen")
    )


def ttl_slots(
    df: DataFrame, ttl: str = "1 hour", metrics: Sequence[str] = METRICS, time: str = "ts"
) -> DataFrame:
    """One row per device and ``ttl``-wide slot of ``time``: first and last time seen, last value of
    each metric and its position. *stream* (update mode, with a watermark on ``time``)"""
    positioned = df.withColumn("__at", event_order())
    slots = positioned.groupBy("device_id", F.window(time, ttl).alias("__slot")).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        *[_latest_of(m, "__at").alias(m) for m in metrics],
        *[F.max(F.when(F.col(m).isNotNull(), F.col("__at"))).alias(f"{m}_at") for m in metrics],
    )
    return slots.withColumn("slot_start", F.col("__slot.start")).drop("__slot")


def alive_values(
    slots: DataFrame, now: Column, ttl: str = "1 hour", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Values of the ``ttl_slots`` that have not expired at ``now``.

    Within a slot no gap can reach ``ttl``, so a gap lies between neighbouring slots of a device;
    everything before the last gap is gone.
    """
    span = F.expr(f"interval {ttl}")
    by_time = Window.partitionBy("device_id").orderBy("slot_start")
    later = by_time.rowsBetween(1, Window.unboundedFollowing)
    breaks = F.col("first_seen") >= F.lag("last_seen").over(by_time) + span
    alive = (
        slots.withColumn("__break", F.coalesce(breaks, F.lit(False)))
        .withColumn("__dead", F.coalesce(F.max("__break").over(later), F.lit(False)))
        .filter(~F.col("__dead"))
    )
    latest = alive.groupBy("device_id").agg(
        *[F.max_by(m, f"{m}_at").alias(m) for m in metrics], F.max("last_seen").alias("last_seen")
    )
    return latest.filter(F.col("last_seen") + span > now)


def latest_unexpired(
    df: DataFrame, now: Column, ttl: str = "1 hour", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """``latest_by_device`` where all values of a device vanish ``ttl`` after its last message.

    A message after a gap of ``ttl`` or more does not bring back values from before the gap.
    Readings are first reduced to slots, so no task needs all readings of one device.
    """
    return alive_values(ttl_slots(df, ttl, metrics), now, ttl, metrics)


def history(df: DataFrame, key: Sequence[str] = ("device_id", "payload")) -> DataFrame:
    """Payloads with a temperature, each stored once per device."""
    return df.filter(F.col("temperature").isNotNull()).dropDuplicates(list(key))


def recent(df: DataFrame, order: Sequence[Column], n: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """The last ``n`` readings."""
    last = df.orderBy(*order).limit(n)
    return last.select(*columns) if columns else last


#: Candidates of ``newest_distinct`` whose copies are looked up; beyond it all rows are de-duplicated.
MOST_CANDIDATES = 100_000


def newest_distinct(df: DataFrame, n: int, arrival: str = "arrival_ts", tie: str = "seq") -> DataFrame:
    """The ``n`` readings of ``distinct_readings`` that arrived last (then by ``tie``), in no order.

    The messages that came last are candidates; only their readings are looked up in the history, by
    a broadcast of at most ``MOST_CANDIDATES`` keys, to see which of them came for the first time.
    Readings that came first before all candidates can't be among the last, so the result
    is settled as soon as ``n`` first arrivals lie above the oldest candidate; until then there are
    four times as many candidates. The history is read, not shuffled.
    """
    keyed = df.withColumn("__reading", reading_key(df))
    order = [F.col(arrival).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    wanted = 2 * n
    while wanted <= MOST_CANDIDATES:
        candidates = keyed.orderBy(*order).limit(wanted)
        count, oldest, times = candidates.agg(
            F.count(F.lit(1)), F.min(arrival), F.count(arrival)
        ).first()
        ids = F.broadcast(candidates.select(F.col("device_id").alias("__device"), F.col("__reading").alias("__known")).distinct())
        same = F.col("device_id").eqNullSafe(F.col("__device")) & F.col("__reading").eqNullSafe(F.col("__known"))
        firsts = distinct_readings(keyed.join(ids, same, "left_semi").drop("__reading"))
        if count < wanted:  # every row is a candidate
            return firsts.orderBy(*order).limit(n)
        if times == count:
            firsts = firsts.filter(F.col(arrival) > F.lit(oldest))
            if firsts.limit(n).count() == n:
                return firsts.orderBy(*order).limit(n)
        wanted *= 4
    return distinct_readings(df).orderBy(*order).limit(n)


def sessions(df: DataFrame, ttl: str = "1 hour", metrics: Sequence[str] = METRICS, time: str = "ts") -> DataFrame:
    """Per device the stretches of readings without a gap of ``ttl`` or more: first_seen, last_seen,
    readings and the last value of each metric. *stream* (append mode, with a watermark on ``time``)"""
    positioned = df.withColumn("__at", event_order())
    # a session window takes in what comes exactly at its end, which is expired
    gap = F.session_window(time, f"{ttl} -1 microseconds")
    found = positioned.groupBy("device_id", gap.alias("__s")).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("readings"),
        *[_latest_of(m, "__at").alias(m) for m in metrics],
    )
    return found.drop("__s")


def device_status(df: DataFrame, order: Column | str = "arrival_ts") -> DataFrame:
    """Status per device of the message that is last in ``order``, of equal ones the greatest.
    *stream* (update mode)"""
    last = F.max(F.struct(as_column(order).alias("at"), "status"))
    found = df.filter(F.col("status").isNotNull()).groupBy("device_id").agg(last.alias("__last"))
    return found.select("device_id", F.col("__last.status").alias("status"))


def windowed_readings(
    df: DataFrame, width: str = "5 minutes", metrics: Sequence[str] = METRICS, time: str = "ts"
) -> DataFrame:
    """Readings and mean metrics per device and tumbling window of ``time``. *stream* (with a
    watermark on ``time``)"""
    instant = isinstance(df.schema[time].dataType, T.TimestampType)
    clock = utc_clock if instant else (lambda c: c)
    return (
        df.groupBy("device_id", F.window(time, width).alias("__w"))
        .agg(F.count(F.lit(1)).alias("readings"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])
        .select(
            "device_id",
            clock(F.col("__w.start")).alias("window_start"),
            clock(F.col("__w.end")).alias("window_end"),
            "readings",
            *[f"avg_{m}" for m in metrics],
        )
    )
