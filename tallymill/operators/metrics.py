"""Counters and gauges: samples of (metric, labels…, ts, value).

A counter's rate is, per series and tumbling window, the increase between neighbouring samples
divided by the seconds between them. A pair belongs to the window of its later sample; a drop
is a reset, after which the new value is the increase; a first sample has no pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.columns import seconds_between


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def _increase(later: Column, earlier: Column) -> Column:
    return F.when(later < earlier, later).otherwise(later - earlier)


def counter_increase(
    df: DataFrame,
    series: Sequence[str],
    width: str = "5 minutes",
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """What the pairs of a window add up to: series columns, window_start, increase, seconds.

    These sums are additive: those of parts of the samples, each with the sample before it, or of
    shorter windows, may be added. ``series`` must name all labels: samples that differ in another one would be taken for one
    counter.

    Neighbours inside one time chunk (the window itself, or the shorter ``chunk`` that must
    divide it) are compared in parallel. Each chunk is then one row with its first and last
    sample, and only those rows are ordered per series to add the pairs across chunks.
    """
    if chunk and _seconds(width) % _seconds(chunk):
        raise ValueError(f"{chunk} does not divide {width}")
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    slot = F.window(ts, chunk or width)
    cut = df.withColumn("__slot", slot.getField("start"))
    ids = [*series, "__slot"]
    inside = Window.partitionBy(*ids).orderBy(*order)
    pairs = cut.withColumns(
        {"__pv": F.lag(value).over(inside), "__pt": F.lag(ts).over(inside), "__i": F.row_number().over(inside)}
    )
    paired = F.col("__pt").isNotNull()
    chunks = pairs.groupBy(*ids).agg(
        F.sum(F.when(paired, _increase(F.col(value), F.col("__pv")))).alias("__inc"),
        F.sum(F.when(paired, seconds_between(ts, "__pt"))).alias("__sec"),
        F.min(ts).alias("__t1"),
        F.max(ts).alias("__t2"),
        F.min_by(value, "__i").alias("__v1"),
        F.max_by(value, "__i").alias("__v2"),
    )
    by_time = Window.partitionBy(*series).orderBy("__slot")
    linked = chunks.withColumns({"__pv": F.lag("__v2").over(by_time), "__pt": F.lag("__t2").over(by_time)})
    linked = linked.withColumns(
        {
            "__link_inc": F.when(paired, _increase(F.col("__v1"), F.col("__pv"))),
            "__link_sec": F.when(paired, seconds_between("__t1", "__pt")),
        }
    )
    window_start = F.window("__slot", width).getField("start") if chunk else F.col("__slot")
    total = lambda a, b: F.coalesce(F.sum(a), F.lit(0.0)) + F.coalesce(F.sum(b), F.lit(0.0))
    return linked.groupBy(*series, window_start.alias("window_start")).agg(
        total("__inc", "__link_inc").alias("increase"), total("__sec", "__link_sec").alias("seconds")
    )


def with_rate(increases: DataFrame) -> DataFrame:
    """Add the rate; windows without any time between samples have none and go."""
    return increases.filter(F.col("seconds") > 0).withColumn("rate", F.col("increase") / F.col("seconds"))


def counter_rate(
    df: DataFrame,
    series: Sequence[str],
    width: str = "5 minutes",
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Rate per series and window: series columns, window_start, increase, seconds, rate."""
    return with_rate(counter_increase(df, series, width, ts, value, tie, chunk))


def counter_rate_sliding(
    df: DataFrame,
    series: Sequence[str],
    width: str = "5 minutes",
    step: str = "1 minute",
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> DataFrame:
    """``counter_rate`` over windows of ``width`` that begin every ``step``.

    Samples are reduced once, to panes one step long; a window is the sum of its panes. So what is
    repeated for overlapping windows is a pane, never a sample.
    """
    if _seconds(width) % _seconds(step):
        raise ValueError(f"{step} does not divide {width}")
    panes = counter_increase(df, series, step, ts, value, tie)
    windows = panes.withColumn("__w", F.window("window_start", width, step)).groupBy(*series, F.col("__w.start").alias("window_start"))
    return with_rate(windows.agg(F.sum("increase").alias("increase"), F.sum("seconds").alias("seconds")))


def cpu_busy(
    df: DataFrame,
    series: Sequence[str] = ("instance", "cpu"),
    by: Sequence[str] = ("instance",),
    width: str = "5 minutes",
    mode: str = "idle",
    tie: str | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """100 minus the mean idle rate in percent, per instance and window."""
    idle = counter_rate(df.filter(F.col("mode") == mode), series, width, tie=tie, chunk=chunk)
    return idle.groupBy(*by, "window_start").agg((100 - F.avg("rate") * 100).alias("cpu_busy"))


def gauge_sum_by(
    df: DataFrame,
    series: Sequence[str],
    by: Sequence[str],
    where: Column | None = None,
    position: Column | str = "ts",
    scale: float = 1 / 1024 / 1024,
    out: str = "total",
) -> DataFrame:
    """Sum over the series of a group of each series' latest sample, times ``scale``."""
    if where is not None:
        df = df.filter(where)
    latest = df.groupBy(*series).agg(F.max_by("value", position).alias("__v"))
    return latest.groupBy(*by).agg((F.sum("__v") * scale).alias(out))


def rate_sum_by(
    df: DataFrame,
    series: Sequence[str],
    by: Sequence[str],
    width: str = "5 minutes",
    where: Column | None = None,
    scale: float = 1.0,
    tie: str | None = None,
    out: str = "total_rate",
    chunk: str | None = None,
) -> DataFrame:
    """Sum of the series' rates per group and window, times ``scale``."""
    if where is not None:
        df = df.filter(where)
    rates = counter_rate(df, series, width, tie=tie, chunk=chunk)
    return rates.groupBy(*by, "window_start").agg((F.sum("rate") * scale).alias(out))


def tx_rx(
    df: DataFrame,
    sent: str,
    received: str,
    series: Sequence[str],
    by: Sequence[str],
    width: str = "5 minutes",
    where: Column | None = None,
    tie: str | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Bytes per second sent and received per group and window, as two labelled series.

    Both metrics go through one pass, with the metric as part of the series.
    """
    both = df.filter(F.col("metric").isin(sent, received))
    rates = rate_sum_by(both, ["metric", *series], ["metric", *by], width, where, 1.0, tie, "bytes_per_second", chunk)
    direction = F.when(F.col("metric") == sent, "TX").otherwise("RX")
    return rates.select(direction.alias("direction"), *by, "window_start", "bytes_per_second")
