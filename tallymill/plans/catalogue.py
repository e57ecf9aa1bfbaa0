"""Every operator as a named query over the benchmark tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.columns import main_value
from tallymill.functions.constants import (
    FIRST_YEAR,
    TOPIC_HUMIDITY,
    TOPIC_STATUS,
    TOPIC_TEMPERATURE,
    TOPICS,
    UNKNOWN,
    UNKNOWN_TITLE,
    UNKNOWN_YEAR,
)
from tallymill.operators import cleaning, comparing, grouping, metrics, profiling, ranking, telemetry, text
from tallymill.plans import pipelines, reports
from tallymill.session import new_path, write_once
from tallymill.sources import (
    add_synthetic_columns,
    read_csv,
    read_csv_split,
    read_first,
    read_lines,
    read_sample_stream,
    read_sensor_stream,
    read_table,
    spread,
    stand_ins,
    write_csv,
)
from tallymill.streaming import exact, jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]

SCORE_DIGITS = 9


def _round(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Drop the last bits of sums of doubles, which depend on the order of addition."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _scores(df: DataFrame) -> DataFrame:
    return _round(df, {"rating_score": SCORE_DIGITS})


def _on_titles(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: report(stand_ins.titles(spark, folder))


def _on_messy(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: report(stand_ins.messy_titles(spark, folder))


def _on_prepared(report: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_messy(lambda df: report(pipelines.prep_analysis(df)))


def _on_stored(report: Callable[[DataFrame], DataFrame]) -> Query:
    """For reports that read the prepared titles more than once."""
    return _on_prepared(lambda df: report(write_once(df, "prepared")))


def _on_table(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: query(read_table(spark, folder, name))


def _on_text(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: query(spread(read_table(spark, folder, "documents").select("text")))


# Sources and sinks


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.titles(spark, folder)
    no_genre = F.when(F.col("movie_id") % 70 == 0, F.lit("")).otherwise(F.col("genres"))
    rows = rows.withColumn("genres", no_genre)
    path = new_path(spark, "titles-csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


def csv_multiline_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = new_path(spark, "documents-csv")
    write_csv(rows, path, multiline=True, rows_per_file=50_000)
    return read_csv(spark, path, rows.schema, multiline=True)


#: Bytes of text in a file of ``csv_multiline_split``: two splits.
CSV_FILE_BYTES = 256 << 20


def csv_multiline_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = new_path(spark, "documents-csv")
    # few large files, as a user would bring them: a small table is one, and no task writes more than one
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    write_csv(rows.coalesce(1 + size // CSV_FILE_BYTES), path, multiline=True)
    return read_csv_split(spark, path, rows.schema)


def source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    paths = [f"{folder}/cleaned_orders.parquet", f"{folder}/orders.parquet"]
    found = read_first(spark, paths, lambda s, p: s.read.parquet(p))
    return grouping.group_stats(found, ["o_orderpriority"], {"orders": ("count",)})


def synth_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = add_synthetic_columns(read_table(spark, folder, "orders"), "o_orderkey")
    return _category_stats(rows, "category", "value", "quantity", 1000)


def _category_stats(df: DataFrame, category: str, value: str, quantity: str, units: int) -> DataFrame:
    """The numeric aggregate; the total is summed in whole ``units`` and is exact in any order."""
    stats = grouping.group_stats(
        df,
        {"category": F.col(category)},
        {
            "cnt": ("count",),
            "total_value": ("sum", F.rint(F.col(value) * units).cast("bigint")),
            "avg_value": ("avg", value, 4),
            "total_qty": ("sum", F.col(quantity).cast("bigint")),
        },
    )
    return stats.withColumn("total_value", F.col("total_value") / units)


# Cleaning


def cast_columns(df: DataFrame) -> DataFrame:
    types = {"amount": "double", "quantity": "int", "code": "int"}
    text_form = df.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.col("l_returnflag").alias("code"),
    )
    return cleaning.cast_columns(text_form, types)


def dedupe_lines(df: DataFrame) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    order = cleaning.total_order(df, keys, [F.col("l_extendedprice").desc_nulls_last()])
    return cleaning.dedupe_key(df, keys, order)


def filled_genres(df: DataFrame) -> DataFrame:
    filled = cleaning.fill_const(df, {"genres": UNKNOWN})
    return reports.genre_known(filled).select("movie_id", "genres")


def _wide(df: DataFrame) -> DataFrame:
    """Numbers from 2^53 on, where doubles skip every other integer."""
    return df.select("movie_id", "countries", (F.lit(1 << 53) + F.col("movie_id") % 4).alias("big"))


def vs_group_avg_large(df: DataFrame) -> DataFrame:
    """The join for group tables too large to broadcast, with a placeholder on three rows in ten."""
    marked = write_once(
        df.select(
            "movie_id",
            "rating_score",
            F.when(F.col("movie_id") % 10 < 3, F.lit(UNKNOWN)).otherwise(main_value("genres")).alias("main"),
        ),
        "marked",
    )
    key = F.col("main")
    compared = comparing.vs_group_avg(
        marked, "genre", key, "rating_score", [F.col("movie_id")], where=F.col("rating_score").isNotNull(), groups_where=key != UNKNOWN, top=None, small=0
    )
    return compared.select("movie_id", "genre", "genre_avg_score", "above_avg")


def lines_read(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as text files, one folder per language, and read line by line."""
    path = new_path(spark, "lines")
    read_table(spark, folder, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    lines = read_lines(spark, path)
    stats = {"lines": ("count",), "chars": ("sum", F.length("value").cast("bigint"))}
    return grouping.group_stats(lines, ["lang"], stats)


def schema_of_titles(df: DataFrame) -> DataFrame:
    """Names and types beside the number of rows."""
    report = profiling.schema_report(df).select("name", "type")
    return report.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


# Telemetry


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Readings only (status messages carry no send time), each once, with latency."""
    rows = telemetry.topic_filter(
        stand_ins.readings(spark, folder), [TOPIC_TEMPERATURE, TOPIC_HUMIDITY]
    )
    return telemetry.latency(telemetry.distinct_readings(rows))


def sensor_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = telemetry.parse_readings(stand_ins.messages(spark, folder))
    text = F.col("bad_payload")
    reject = (
        F.when(text.startswith("not json"), "not json")
        .when(text == "{}", text)
        .when(F.col("ts").isNull(), "time")
        .when(text.isNotNull(), "nothing")
    )
    return parsed.select(
        "topic", "arrival_ts", "device_id", "ts", "temperature", "humidity", "seq", "status", reject.alias("reject")
    )


def readings_without_seq(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that carry no number are told apart by what they say."""
    parsed = telemetry.good_readings(telemetry.parse_readings(stand_ins.messages(spark, folder)))
    single = telemetry.distinct_readings(telemetry.readings_only(parsed).where("seq is null"))
    return single.select("device_id", "ts", "temperature", "humidity")


def rolling_by(*keys: str, order: str = "ts") -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        # Numbering reads its input three times; the de-duplication is done once.
        rows = telemetry.rolling_mean(
            write_once(_measured(spark, folder), "readings"),
            keys,
            [(order, "asc"), ("seq", "asc")],
            "latency",
            "avg_latency",
            n=500,
            digits=12,
        )
        return rows.select("device_id", "topic", "seq", "ts", "latency", "avg_latency")

    return query


def _last_first() -> list:
    return [F.col("arrival_ts").desc_nulls_last(), F.col("seq").desc_nulls_last()]


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.topic_filter(stand_ins.readings(spark, folder), [TOPIC_TEMPERATURE, TOPIC_HUMIDITY])


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    last = telemetry.latency(telemetry.newest_distinct(_numbered(spark, folder), 500))
    return telemetry.latency_summary(last, _last_first())


def recent_readings(spark: SparkSession, folder: str) -> DataFrame:
    last = telemetry.recent(telemetry.latency(telemetry.newest_distinct(_numbered(spark, folder), 100)), _last_first())
    return last.select(
        F.col("device_id").alias("device"),
        "topic",
        F.col("temperature").alias("temp"),
        F.col("humidity").alias("humid"),
        "latency_ms",
    )


def unexpired(ttl: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = stand_ins.readings(spark, folder)
        now = rows.agg(F.max("ts")).scalar()
        return telemetry.latest_unexpired(rows, now, ttl)

    return query


def reading_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.readings(spark, folder)
    payload = F.to_json(F.struct("device_id", "seq", "ts", "temperature", "humidity"))
    stored = telemetry.history(rows.withColumn("payload", payload))
    return stored.select("device_id", "seq", "ts", "temperature", "humidity")


def device_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry.topic_filter(stand_ins.readings(spark, folder), [TOPIC_STATUS])
    return telemetry.device_status(rows, telemetry.event_order("arrival_ts"))


def windowed_readings(spark: SparkSession, folder: str) -> DataFrame:
    windows = telemetry.windowed_readings(telemetry.distinct_readings(stand_ins.readings(spark, folder)))
    return _round(windows, {"avg_temperature": 6, "avg_humidity": 6})


# Streams. The messages are written as a feed of files and read back in two batches or more: in any
# order where the job has no watermark, in order of arrival where it has one.


def _feed(spark: SparkSession, folder: str) -> tuple[DataFrame, str, str]:
    root = new_path(spark, "feed")
    files = max(spark.sparkContext.defaultParallelism, 2)
    writer = stand_ins.messages(spark, folder).repartition(files).write
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/in")
    stream = read_sensor_stream(spark, f"{root}/in", TOPICS, math.ceil(files / 2))
    return stream, f"{root}/out", f"{root}/checkpoint"


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    feed, out, checkpoint = _feed(spark, folder)
    jobs.start_latest(feed, out, checkpoint).awaitTermination()
    return jobs.latest(spark, out)


def stream_unexpired(spark: SparkSession, folder: str) -> DataFrame:
    feed, root = _in_order_of_arrival(spark, folder)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    jobs.start_slots(feed, out, checkpoint, "1 day").awaitTermination()
    now = sinks.current_rows(spark, out, ["device_id", "slot_start"]).agg(F.max("last_seen")).scalar()
    return jobs.unexpired(spark, out, now, "1 day")


def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    feed, root = _in_order_of_arrival(spark, folder)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    jobs.start_history(feed, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("device_id", "seq", "ts", "temperature", "humidity")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    feed, root = _in_order_of_arrival(spark, folder)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    jobs.start_windows(feed, out, checkpoint, "5 minutes").awaitTermination()
    return _round(jobs.windows(spark, out), {"avg_temperature": 6, "avg_humidity": 6})


def _redelivered(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Three batches: the later half of the time, the earlier half, and every fifth message again."""
    root = new_path(spark, "feed")
    files = max(spark.sparkContext.defaultParallelism, 2)
    rows = stand_ins.messages(spark, folder)
    first, last = rows.agg(F.min("arrival_ts"), F.max("arrival_ts")).first()
    middle = F.lit(first + (last - first) / 2)
    again = F.crc32(F.col("value").cast("binary")) % 5 == 0
    for part, wanted in enumerate((F.col("arrival_ts") >= middle, F.col("arrival_ts") < middle, again)):
        writer = rows.where(wanted).repartition(files).write.mode("append")
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/in")
        time.sleep(0.05)  # files are read in the order of their times
    return read_sensor_stream(spark, f"{root}/in", TOPICS, files), root


def stream_history_exact(spark: SparkSession, folder: str) -> DataFrame:
    stream, root = _redelivered(spark, folder)
    exact.start_readings(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return exact.history(spark, f"{root}/out").select("device_id", "seq", "ts", "temperature", "humidity")


def stream_windows_exact(spark: SparkSession, folder: str) -> DataFrame:
    stream, root = _redelivered(spark, folder)
    exact.start_readings(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _round(exact.windows(spark, f"{root}/out"), {"avg_temperature": 6, "avg_humidity": 6})


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that a watermark of two hours has closed."""
    stream, root = _in_order_of_arrival(spark, folder)
    jobs.start_sessions(stream, f"{root}/out", f"{root}/checkpoint", "1 day", "2 hours").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    feed, out, checkpoint = _feed(spark, folder)
    jobs.start_status(feed, out, checkpoint).awaitTermination()
    return jobs.status(spark, out)


def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    feed, out, checkpoint = _feed(spark, folder)
    sinks.start_rejects(feed, out, checkpoint).awaitTermination()
    text = F.col("value")
    # payloads of numbers are named, since engines print doubles differently
    short = F.when(text.startswith("not") | (text == "{}") | text.contains("NaN"), text).when(text.contains('"seq"'), "millis")
    return spark.read.parquet(out).select("topic", "arrival_ts", F.coalesce(short, F.lit("nothing")).alias("value"))


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, the second with every third message: what lies over a day behind the first."""
    root = new_path(spark, "feed")
    rows = stand_ins.messages(spark, folder)
    files = max(spark.sparkContext.defaultParallelism, 2)
    number = F.coalesce(F.get_json_object("value", "$.seq").cast("bigint"), F.lit(1))
    for part, wanted in enumerate((number % 3 != 0, number % 3 == 0)):
        writer = rows.where(wanted).repartition(files).write.mode("append")
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/in")
        time.sleep(0.05 * (1 - part))  # files are read in the order of their times
    stream = read_sensor_stream(spark, f"{root}/in", TOPICS, files)
    sinks.start_late_rows(stream, f"{root}/out", f"{root}/checkpoint", 86_400).awaitTermination()
    return sinks.late_rows(spark, f"{root}/out").select("device_id", "seq", "ts", "temperature", "humidity", "arrival_ts")


def _in_order_of_arrival(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The feed in two batches, the earlier half of the time first."""
    root = new_path(spark, "feed")
    files = max(spark.sparkContext.defaultParallelism, 2)
    rows = stand_ins.messages(spark, folder)
    first, last = rows.agg(F.min("arrival_ts"), F.max("arrival_ts")).first()
    middle = F.lit(first + (last - first) / 2)
    for part, wanted in enumerate((F.col("arrival_ts") < middle, F.col("arrival_ts") >= middle)):
        writer = rows.where(wanted).repartition(files).write.mode("append")
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/in")
        time.sleep(0.05 * (1 - part))
    return read_sensor_stream(spark, f"{root}/in", TOPICS, files), root


def stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    stream, root = _in_order_of_arrival(spark, folder)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    means = sinks.latencies(spark, f"{root}/out")
    return _round(means, {"avg_latency": 12}).select("device_id", "seq", "ts", "arrival_ts", "latency", "avg_latency")


def stream_latency_by_device(spark: SparkSession, folder: str) -> DataFrame:
    stream, root = _in_order_of_arrival(spark, folder)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint", n=20, keys=["device_id"]).awaitTermination()
    means = sinks.latencies(spark, f"{root}/out")
    return _round(means, {"avg_latency": 12}).select("device_id", "seq", "ts", "arrival_ts", "latency", "avg_latency")


def stream_latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    stream, root = _in_order_of_arrival(spark, folder)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return telemetry.latency_summary(sinks.last_readings(spark, f"{root}/out"), [F.col("arrival_ts").desc(), F.col("seq").desc_nulls_first()])


# Metrics


def _workload() -> Column:
    return (F.col("namespace") == "default") & (F.col("container") != "")


def _metric(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return stand_ins.metrics(spark, folder).filter(F.col("metric").isin(*names))


def counter_rates(width: str, chunk: str | None = None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        sent = _metric(spark, folder, "net_tx")
        rates = metrics.counter_rate(sent, stand_ins.METRIC_LABELS, width, tie="event_id", chunk=chunk)
        return _round(rates, {"seconds": 6, "rate": 9})

    return query


def counter_rate_sliding(spark: SparkSession, folder: str) -> DataFrame:
    rates = metrics.counter_rate_sliding(_metric(spark, folder, "net_tx"), stand_ins.METRIC_LABELS, tie="event_id")
    return _round(rates, {"seconds": 6, "rate": 9})


def stream_counter_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The samples in three batches by time."""
    root = new_path(spark, "feed")
    files = max(spark.sparkContext.defaultParallelism, 2)
    rows = stand_ins.metrics(spark, folder)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    part = F.when(F.col("ts") < F.lit(first + third), 0).when(F.col("ts") < F.lit(first + 2 * third), 1).otherwise(2)
    for number in range(3):
        rows.where(part == number).repartition(files).write.mode("append").parquet(f"{root}/in")
        time.sleep(0.05)
    stream = read_sample_stream(spark, f"{root}/in", rows.schema, files)
    exact.start_counter_rates(
        stream, f"{root}/out", f"{root}/checkpoint", stand_ins.METRIC_LABELS, "1 day", F.col("metric") == "net_tx", "event_id", "1 hour"
    ).awaitTermination()
    return _round(exact.counter_rates(spark, f"{root}/out", stand_ins.METRIC_LABELS), {"seconds": 6, "rate": 9})


def cpu_busy(spark: SparkSession, folder: str) -> DataFrame:
    busy = metrics.cpu_busy(
        _metric(spark, folder, "cpu_seconds"), stand_ins.METRIC_LABELS, ["instance"], "1 day", tie="event_id", chunk="2 hours"
    )
    return _round(busy, {"cpu_busy": 6})


def gauge_sum_by(spark: SparkSession, folder: str) -> DataFrame:
    memory = metrics.gauge_sum_by(
        _metric(spark, folder, "memory_bytes"),
        stand_ins.METRIC_LABELS,
        ["pod"],
        where=_workload(),
        position=telemetry.event_order("ts", "event_id"),
        out="memory_mib",
    )
    return _round(memory, {"memory_mib": 9})


def rate_sum_by(spark: SparkSession, folder: str) -> DataFrame:
    usage = metrics.rate_sum_by(
        _metric(spark, folder, "cpu_seconds"),
        stand_ins.METRIC_LABELS,
        ["pod"],
        "1 day",
        where=_workload(),
        scale=100.0,
        tie="event_id",
        out="cpu_percent",
        chunk="2 hours",
    )
    return _round(usage, {"cpu_percent": 6})


def tx_rx(spark: SparkSession, folder: str) -> DataFrame:
    traffic = metrics.tx_rx(
        stand_ins.metrics(spark, folder),
        "net_tx",
        "net_rx",
        stand_ins.METRIC_LABELS,
        ["pod"],
        "1 day",
        where=F.col("namespace") == "default",
        tie="event_id",
        chunk="2 hours",
    )
    return _round(traffic, {"bytes_per_second": 9})


# Integer columns that may be NULL, per query. They are returned as text, which keeps every digit,
# because clients that turn results into data frames do not agree on NULL in an integer column.
NULLABLE_INTEGERS = {
    "csv_roundtrip": ["year"],
    "drop_missing": ["movie_id"],
    "fill_const": ["movie_id"],
    "fill_mean": ["movie_id", "year"],
    "filter_range": ["movie_id", "year"],
    "filter_min_or_sentinel": ["movie_id"],
    "cast_columns": ["code"],
    "trim_strings": ["movie_id", "year"],
    "prep_analysis": ["movie_id"],
    "prep_bench": ["movie_id"],
    "hidden_gems": ["year"],
    "global_percent_rank": ["year"],
    "sensor_parse": ["seq"],
    "stream_late": ["seq"],
    "stream_history_exact": ["seq"],
    "stream_latency": ["seq"],
    "stream_latency_by_device": ["seq"],
}


def _as_text(query: Query, columns: list[str]) -> Query:
    return lambda spark, folder: query(spark, folder).withColumns(
        {c: F.col(c).cast("string") for c in columns}
    )


def queries() -> dict[str, Query]:
    return {
        name: _as_text(query, NULLABLE_INTEGERS[name]) if name in NULLABLE_INTEGERS else query
        for name, query in _queries().items()
    }


def _queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "csv_roundtrip": csv_roundtrip,
        "csv_multiline_roundtrip": csv_multiline_roundtrip,
        "csv_multiline_split": csv_multiline_split,
        "source_fallback": source_fallback,
        "synth_group": synth_group,
        "read_lines": lines_read,
        # profiles
        "schema_report": _on_titles(schema_of_titles),
        "missing_counts": _on_messy(profiling.missing_counts),
        "missing_rates": _on_messy(
            lambda df: _round(profiling.missing_rates(df), {c: 6 for c in df.columns})
        ),
        "summary_stats": _on_table(
            "events", lambda df: _round(profiling.summary_stats(df, "value"), {"mean": 6, "stddev": 6})
        ),
        "describe_long": _on_table(
            "lineitem",
            lambda df: _round(
                profiling.describe_long(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]),
                {"mean": 4, "stddev": 4},
            ),
        ),
        # cleaning
        "drop_missing": _on_messy(lambda df: cleaning.drop_missing(df, ["year", "rating_score"])),
        "fill_const": _on_messy(
            lambda df: cleaning.fill_const(df, {"title": UNKNOWN_TITLE, "genres": UNKNOWN, "year": 0})
        ),
        "fill_mean": _on_messy(lambda df: _scores(cleaning.fill_mean(df, "rating_score"))),
        "dedupe_rows": _on_table("documents", lambda df: cleaning.dedupe_rows(df.drop("doc_id"))),
        "dedupe_key": _on_table("lineitem", dedupe_lines),
        "filter_range": _on_messy(lambda df: cleaning.filter_range(df, "rating_score", 1.0, 10.0)),
        "filter_min_or_sentinel": _on_messy(
            lambda df: cleaning.filter_min_or_sentinel(
                cleaning.fill_const(df, {"year": UNKNOWN_YEAR}), "year", FIRST_YEAR, UNKNOWN_YEAR
            )
        ),
        "filter_sigma": _on_table(
            "events", lambda df: cleaning.filter_sigma(df, "value").select("event_id", "value")
        ),
        "cast_columns": _on_table("lineitem", cast_columns),
        "trim_strings": _on_messy(cleaning.trim_strings),
        "clean_cluster": _on_messy(lambda df: _scores(pipelines.clean_cluster(df))),
        "clean_local": _on_messy(lambda df: _scores(pipelines.clean_local(df))),
        "prep_analysis": _on_messy(lambda df: _scores(pipelines.prep_analysis(df))),
        "prep_bench": _on_messy(pipelines.prep_bench),
        "clean_audit": _on_messy(lambda df: pipelines.clean_audit(df, pipelines.LOCAL_STEPS)),
        "clean_audit_cluster": _on_messy(lambda df: pipelines.clean_audit(df, pipelines.CLUSTER_STEPS)),
        # projections and comparisons
        "project": _on_table("lineitem", lambda df: df.select("l_returnflag", "l_extendedprice")),
        "main_value": _on_titles(
            lambda df: df.select(
                "movie_id",
                main_value("genres").alias("main_genre"),
                main_value("countries").alias("main_country"),
                main_value("directors").alias("main_director"),
            )
        ),
        "sentinel_filter": _on_titles(filled_genres),
        "above_avg_collect": _on_stored(lambda df: _scores(reports.above_avg_collect(df))),
        "hidden_gems": _on_titles(reports.good_but_overlooked),
        "vs_group_avg": _on_stored(lambda df: _scores(reports.vs_genre_avg(df))),
        "vs_group_avg_large": _on_titles(vs_group_avg_large),
        # aggregates
        "genre_stats": _on_titles(reports.genre_stats),
        "genre_stats_full": _on_prepared(reports.genre_stats_full),
        "genre_stats_bench": _on_messy(lambda df: reports.genre_stats_bench(pipelines.prep_bench(df))),
        "genre_stats_main": _on_messy(lambda df: reports.genre_stats_main(pipelines.prep_genre(df))),
        "genre_stats_nonnull": _on_messy(
            lambda df: _round(
                reports.genre_stats_nonnull(df), {"avg_rating": 6, "avg_votes": 4}
            )
        ),
        "country_stats": _on_titles(reports.country_stats),
        "country_stats_local": _on_prepared(reports.country_stats_local),
        "year_high_rated": _on_titles(reports.year_high_rated),
        "year_high_top": _on_prepared(reports.year_high_top),
        "decade_trend": _on_titles(reports.decade_stats),
        "decade_trend_local": _on_prepared(reports.decade_stats_local),
        "director_stats": _on_titles(reports.director_stats),
        "popularity_quality": _on_titles(reports.popularity_quality),
        "genre_country": _on_titles(reports.genre_country),
        "table_summary": _on_prepared(reports.overview),
        "top_value": _on_titles(lambda df: grouping.top_value(df, "genres")),
        "distinct_count": _on_titles(lambda df: grouping.distinct_count(df, "genres")),
        "word_count": _on_text(lambda df: text.word_count(df, "text", top=20)),
        "word_totals": _on_text(lambda df: text.word_totals(text.word_count(df, "text"))),
        "word_count_raw": _on_text(lambda df: text.word_count_plain(df, "text", top=10)),
        "category_agg": _on_table(
            "lineitem",
            lambda df: _category_stats(df, "l_returnflag", "l_extendedprice", "l_quantity", 100),
        ),
        "category_count_filtered": _on_table(
            "lineitem",
            lambda df: grouping.group_stats(
                df, {"category": F.col("l_returnflag")}, {"count": ("count",)}, where=F.col("l_extendedprice") > 50000
            ),
        ),
        # ranks and top-k
        "top3_per_genre": _on_titles(reports.top3_per_genre),
        "genre_ranks": _on_stored(lambda df: _scores(reports.genre_ranks(df))),
        "global_percent_rank": _on_titles(reports.global_percent_rank),
        "percent_rank_all": _on_titles(
            lambda df: ranking.percent_rank_global(
                write_once(df.select("movie_id", "rating_score"), "scores"), "rating_score", digits=9
            ).select("movie_id", "percentile")
        ),
        "percent_rank_wide": _on_titles(
            lambda df: ranking.percent_rank_global(write_once(_wide(df), "wide"), "big", digits=9).select("movie_id", "percentile")
        ),
        "row_number_wide": _on_titles(
            lambda df: ranking.row_numbers(write_once(_wide(df), "wide"), ["countries"], [("big", "asc"), ("movie_id", "asc")]).select(
                "movie_id", "rn"
            )
        ),
        "row_number_by_text": _on_titles(
            lambda df: ranking.row_numbers(
                write_once(df.select("movie_id", "directors"), "directors"), [], [("directors", "asc"), ("movie_id", "asc")]
            ).select("movie_id", "rn")
        ),
        "genre_row_number": _on_titles(lambda df: reports.genre_row_number(pipelines.prep_bench(df))),
        "top50_titles": _on_titles(lambda df: reports.top50_titles(pipelines.prep_bench(df))),
        "top100_value": _on_table(
            "lineitem",
            lambda df: grouping.top_k(df, [F.col("l_extendedprice").desc()], 100, ["l_extendedprice"]),
        ),
        # telemetry
        "sensor_parse": sensor_parse,
        "readings_without_seq": readings_without_seq,
        "topic_filter": lambda spark, folder: telemetry.topic_filter(
            stand_ins.readings(spark, folder), [TOPIC_TEMPERATURE, TOPIC_HUMIDITY]
        ).select("device_id", "seq", "topic"),
        "latency": lambda spark, folder: _measured(spark, folder).select(
            "device_id", "seq", "latency", "latency_ms"
        ),
        "rolling_mean": rolling_by("device_id"),
        "rolling_mean_by_topic": rolling_by("topic"),
        "rolling_mean_all": rolling_by(order="arrival_ts"),
        "latency_summary": latency_summary,
        "latest_by_device": lambda spark, folder: telemetry.latest_by_device(
            stand_ins.readings(spark, folder)
        ),
        "latest_unexpired": unexpired("1 hour"),
        "latest_unexpired_day": unexpired("1 day"),
        "reading_history": reading_history,
        "recent_readings": recent_readings,
        "device_status": device_status,
        "windowed_readings": windowed_readings,
        "stream_latest": stream_latest,
        "stream_unexpired": stream_unexpired,
        "stream_history": stream_history,
        "stream_history_exact": stream_history_exact,
        "stream_windows": stream_windows,
        "stream_windows_exact": stream_windows_exact,
        "stream_sessions": stream_sessions,
        "stream_status": stream_status,
        "stream_rejects": stream_rejects,
        "stream_late": stream_late,
        "stream_latency": stream_latency,
        "stream_latency_by_device": stream_latency_by_device,
        "stream_latency_summary": stream_latency_summary,
        # metrics
        "counter_rate": counter_rates("1 day", "1 hour"),
        "counter_rate_5_minutes": counter_rates("5 minutes"),
        "counter_rate_sliding": counter_rate_sliding,
        "stream_counter_rate": stream_counter_rate,
        "cpu_busy": cpu_busy,
        "gauge_sum_by": gauge_sum_by,
        "rate_sum_by": rate_sum_by,
        "tx_rx": tx_rx,
    }
