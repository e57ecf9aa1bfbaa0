"""Title, telemetry and metric tables derived from the benchmark tables, defects included.

The benchmark tables hold no NULLs and no copies; these views add them by arithmetic on the
keys, and keep every row of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.constants import TOPIC_HUMIDITY, TOPIC_STATUS, TOPIC_TEMPERATURE
from tallymill.sources.files import read_table, spread


METRIC_NAMES = ("cpu_seconds", "memory_bytes", "net_tx", "net_rx")
#: With the metric's name, all of them together make a series.
METRIC_LABELS = ("instance", "pod", "namespace", "container", "mode")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _every(column: str, n: int) -> Column:
    return F.col(column) % n == 0


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """One title per order, with gaps; movie_id is unique."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    key = F.col("o_orderkey")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    suffix = F.when(_every("o_orderkey", 3), F.lit("/NATION_X")).otherwise(F.lit(""))
    return rows.select(
        key.alias("movie_id"),
        _unless(_every("o_orderkey", 50), F.concat(F.lit("Title "), key.cast("string"))).alias("title"),
        _unless(_every("o_orderkey", 33), F.year("o_orderdate")).alias("year"),
        _unless(_every("o_orderkey", 20), F.col("o_totalprice") / 50000).alias("rating_score"),
        ((key * 7919) % 1000003).alias("rating_count"),
        _unless(
            _every("o_orderkey", 40),
            F.concat(F.substring("o_orderpriority", 3, 100), F.lit("/"), F.col("c_mktsegment")),
        ).alias("genres"),
        F.concat("n_name", suffix).alias("countries"),
        F.col("c_name").alias("directors"),
        ((key * 104729) % 500009).alias("collect_count"),
    )


def messy_titles(spark: SparkSession, folder: str) -> DataFrame:
    """``titles`` with copies, missing ids, padded titles, impossible years and extreme votes."""
    key = F.col("movie_id")
    copies = (
        F.when(_every("movie_id", 25), F.array(F.lit(0), F.lit(0)))
        .when(_every("movie_id", 30), F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    votes = F.when(_every("movie_id", 97), F.col("rating_count") * 20).otherwise(F.col("rating_count"))
    return (
        titles(spark, folder)
        .withColumn("copy", F.explode(copies))
        .select(
            _unless(_every("movie_id", 61), key).alias("movie_id"),
            F.when(_every("movie_id", 4), F.concat(F.lit("  "), F.col("title"), F.lit(" ")))
            .otherwise(F.col("title"))
            .alias("title"),
            F.when(_every("movie_id", 45), F.lit(1500)).otherwise(F.col("year")).alias("year"),
            "rating_score",
            (votes + F.col("copy") * 1000).alias("rating_count"),
            "genres",
            "countries",
            "directors",
            "collect_count",
        )
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One message per event and a second delivery of every eighth, five seconds later."""
    return _delivered(read_table(spark, folder, "events"))


def _delivered(events: DataFrame) -> DataFrame:
    event_id, user = F.col("event_id"), F.col("user_id").cast("string")
    deliveries = F.when(_every("event_id", 8), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delay = (event_id % 1000 + F.col("delivery") * 5000) / 1000
    zero = F.lit(0)
    return events.withColumn("delivery", F.explode(deliveries)).select(
        F.when(_every("user_id", 7), F.concat(F.lit("d"), user))
        .otherwise(F.concat(F.lit("dev-"), user))
        .alias("device_id"),
        event_id.alias("seq"),
        "ts",
        (F.col("ts") + F.make_dt_interval(zero, zero, zero, delay.cast("decimal(18,6)"))).alias("arrival_ts"),
        F.when(F.col("event_type").isin("view", "click"), TOPIC_TEMPERATURE)
        .when(F.col("event_type") == "error", TOPIC_STATUS)
        .otherwise(TOPIC_HUMIDITY)
        .alias("topic"),
        _unless(_every("event_id", 10), F.col("value")).alias("temperature"),
        _unless(_every("event_id", 15), 60 - F.col("value") / 10).alias("humidity"),
        F.when(_every("event_id", 3), F.lit("offline")).otherwise(F.lit("online")).alias("status"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The same readings as JSON text, mixed with status messages, empty objects, payloads that
    name the ``device`` only, readings without a sequence number, times in milliseconds or NaN, and
    text that is not JSON."""
    rows = _delivered(spread(read_table(spark, folder, "events")))
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    gap = F.col("ts") - epoch
    seconds = (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
        + F.extract(F.lit("SECOND"), gap)
    ).cast("double")
    full = F.struct(
        "device_id",
        seconds.alias("timestamp"),
        "temperature",
        "humidity",
        F.lit("celsius").alias("unit_temp"),
        F.lit("percent").alias("unit_humid"),
        "seq",
    )
    short = F.struct(
        F.col("device_id").alias("device"), "seq", "temperature", "humidity", seconds.alias("timestamp")
    )
    unnumbered = F.struct("device_id", "temperature", "humidity", seconds.alias("timestamp"))
    in_millis = F.struct("device_id", "seq", "temperature", (seconds * 1000).alias("timestamp"))
    no_number = F.concat(F.lit('{"timestamp": NaN, "temperature": 1.0, "seq": '), F.col("seq").cast("string"), F.lit("}"))
    status = F.struct(F.col("device_id").alias("device"), "status")
    return rows.select(
        "topic",
        F.when(_every("seq", 19), F.concat(F.lit("not json "), F.col("seq").cast("string")))
        .when(_every("seq", 23), F.lit("{}"))
        .when(F.col("topic") == TOPIC_STATUS, F.to_json(status))
        .when(_every("seq", 29), F.to_json(in_millis))
        .when(_every("seq", 31), no_number)
        .when(_every("seq", 11), F.to_json(unnumbered))
        .when(_every("seq", 7), F.to_json(short))
        .otherwise(F.to_json(full))
        .alias("value"),
        "arrival_ts",
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One sample of one of four metrics per event, with all labels; counters reset often."""
    events = read_table(spark, folder, "events")
    event_id, user = F.col("event_id"), F.col("user_id")
    return events.select(
        F.element_at(F.array(*map(F.lit, METRIC_NAMES)), (event_id % 4 + 1).cast("int")).alias("metric"),
        F.concat(F.lit("node-"), (user % 5).cast("string")).alias("instance"),
        F.concat(F.lit("pod-"), user.cast("string")).alias("pod"),
        F.when(_every("user_id", 4), F.lit("kube-system")).otherwise(F.lit("default")).alias("namespace"),
        F.when(_every("event_id", 13), F.lit("")).otherwise(F.lit("c1")).alias("container"),
        F.when(_every("event_id", 5), F.lit("user")).otherwise(F.lit("idle")).alias("mode"),
        "ts",
        "event_id",
        (event_id % 1000).cast("double").alias("value"),
    )
