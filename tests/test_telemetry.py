import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import epoch_micros, seconds_between, timestamp_from_epoch
from tallymill.operators import metrics, telemetry

T0 = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def epoch(seconds):
    return (at(seconds) - EPOCH).total_seconds()


READING = "device_id string, seq bigint, ts timestamp_ntz, temperature double, humidity double"


def test_time_helpers_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(1711850399.25, at(90.5), at(0))], "e double, b timestamp_ntz, a timestamp_ntz")
    out = df.select(
        timestamp_from_epoch("e").alias("ts"), epoch_micros("a").alias("us"), seconds_between("b", "a").alias("gap")
    )
    expected = (dt.datetime(2024, 3, 31, 1, 59, 59, 250000), int(epoch(0) * 1_000_000), 90.5)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert tuple(out.first()) == expected
            assert tuple(out.select(seconds_between("ts", "ts")).first()) == (0.0,)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_parse_readings(spark):
    full = {"device_id": "d1", "timestamp": epoch(1.5), "temperature": 20.5, "humidity": 40.0, "seq": 3}
    payloads = [
        json.dumps(full),
        json.dumps({"device": "d2", "timestamp": epoch(2), "temperature": None, "seq": 4}),
        json.dumps({"device": "d3", "status": "online"}),
        "{}",
        "not json",
        json.dumps({"device_id": "d1", "temperature": "warm"}),
        None,
        json.dumps({**full, "timestamp": epoch(1.5) * 1000}),
        json.dumps({**full, "timestamp": float("nan")}),
        json.dumps({"device_id": "d4", "timestamp": epoch(3), "humidity": 1.0}),
    ]
    raw = spark.createDataFrame([("t", p) for p in payloads], "topic string, value string")
    rows = telemetry.parse_readings(raw).collect()
    assert [r.device_id for r in rows[:5]] == ["d1", "d2", "d3", "unknown", "unknown"]
    assert rows[0].ts == at(1.5) and rows[0].temperature == 20.5
    assert rows[1].temperature is None and rows[2].status == "online" and rows[3].ts == EPOCH
    assert [r.bad_payload is not None for r in rows] == [False] * 3 + [True] * 6 + [False]
    assert rows[7].ts is None and rows[8].ts is None
    good = telemetry.good_readings(telemetry.parse_readings(raw))
    assert good.count() == 4
    # one has no sequence number and is a reading all the same; the status message is none
    assert [r.device_id for r in telemetry.readings_only(good).collect()] == ["d1", "d2", "d4"]
    rejected = [r.value for r in telemetry.rejected(telemetry.parse_readings(raw)).collect()]
    assert rejected == [*payloads[3:6], "", *payloads[7:9]]


def test_latency_and_topics(spark):
    df = spark.createDataFrame(
        [("sensors/temperature", at(0), at(0.12345)), ("other", at(0), at(1))],
        "topic string, ts timestamp_ntz, arrival_ts timestamp_ntz",
    )
    rows = telemetry.latency(telemetry.topic_filter(df)).collect()
    assert [(r.latency, r.latency_ms) for r in rows] == [(0.12345, 123.5)]


def test_distinct_readings_keep_the_first_arrival(spark):
    df = spark.createDataFrame(
        [("d", 1, "b", at(2)), ("d", 1, "a", at(2)), ("d", 1, "c", at(9)), ("d", 2, "c", at(3))],
        "device_id string, seq bigint, topic string, arrival_ts timestamp_ntz",
    )
    assert sorted((r.seq, r.topic) for r in telemetry.distinct_readings(df).collect()) == [(1, "a"), (2, "c")]


def test_readings_without_a_number_are_told_apart(spark):
    df = spark.createDataFrame(
        [("d", None, at(1), 1.0, at(2)), ("d", None, at(1), 1.0, at(3)), ("d", None, at(1), 2.0, at(2)), ("d", None, at(4), 1.0, at(2))],
        "device_id string, seq bigint, ts timestamp_ntz, temperature double, arrival_ts timestamp_ntz",
    ).withColumn("topic", F.lit("t"))
    kept = telemetry.distinct_readings(df).collect()
    assert sorted((r.ts, r.temperature, r.arrival_ts) for r in kept) == [(at(1), 1.0, at(2)), (at(1), 2.0, at(2)), (at(4), 1.0, at(2))]


def test_status_ties_are_settled(spark):
    rows = [("d", "offline", at(1)), ("d", "online", at(1)), ("e", "online", at(2)), ("e", "offline", at(3))]
    df = spark.createDataFrame(rows, "device_id string, status string, arrival_ts timestamp_ntz")
    assert {r.device_id: r.status for r in telemetry.device_status(df).collect()} == {"d": "online", "e": "offline"}


@pytest.mark.parametrize("n, block_rows", [(1, 1), (5, 5), (7, 64), (500, 1000)])
def test_rolling_mean_matches_the_window(spark, n, block_rows):
    rng = random.Random(n)
    rows = [
        ("hot" if rng.random() < 0.7 else rng.choice(["a", None]), i, at(rng.randrange(300)), rng.choice([None, float(rng.randrange(100))]))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "device_id string, seq bigint, ts timestamp_ntz, x double")
    got = telemetry.rolling_mean(
        df, ["device_id"], [("ts", "asc"), ("seq", "asc")], "x", "m", n=n, digits=9, parts=6, block_rows=block_rows
    )
    frame = W.partitionBy("device_id").orderBy("ts", "seq").rowsBetween(-(n - 1), 0)
    want = df.withColumn("m", F.round(F.avg("x").over(frame), 9))
    assert got.count() == 1500 and got.exceptAll(want).count() == 0


def test_rolling_mean_over_all_devices(spark):
    df = spark.createDataFrame([(i, at(i // 3), float(i * 7 % 11)) for i in range(400)], "seq bigint, ts timestamp_ntz, x double")
    got = telemetry.rolling_mean(df, [], [("ts", "asc"), ("seq", "asc")], "x", "m", n=9, digits=9, parts=5, block_rows=50)
    want = df.withColumn("m", F.round(F.avg("x").over(W.orderBy("ts", "seq").rowsBetween(-8, 0)), 9))
    assert got.count() == 400 and got.exceptAll(want).count() == 0


def test_latency_summary(spark):
    df = spark.createDataFrame([(i, i / 1000) for i in range(600)], "seq bigint, latency double")
    row = telemetry.latency_summary(df, [F.desc("seq")]).first()
    assert (row.samples, row.avg_ms, row.max_ms, row.min_ms) == (500, 349.5, 599.0, 100.0)
    assert telemetry.latency_summary(df.limit(0), [F.desc("seq")]).first().samples == 0


def test_latest_by_device_orders_by_time_then_seq(spark):
    df = spark.createDataFrame(
        [
            ("d", 1, at(0), 1.0, 10.0),
            ("d", 3, at(5), 3.0, None),
            ("d", 2, at(5), 2.0, 20.0),
            ("d", 4, at(6), None, None),
            ("d", 0, at(-9), 99.0, 99.0),
            ("e", 1, at(-100_000_000), None, 1.0),
        ],
        READING,
    )
    rows = {r.device_id: tuple(r)[1:] for r in telemetry.latest_by_device(df).collect()}
    assert rows == {"d": (3.0, 20.0, at(6)), "e": (None, 1.0, at(-100_000_000))}


def store_with_expiry(rows, now, ttl):
    """The store's behaviour replayed message by message, in time order."""
    store = {}
    for device, _, ts, temperature, humidity in sorted(rows, key=lambda r: (r[2], r[1])):
        entry = store.get(device)
        if entry is None or ts - entry["seen"] >= ttl:
            entry = store[device] = {"temperature": None, "humidity": None}
        if temperature is not None:
            entry["temperature"] = temperature
        if humidity is not None:
            entry["humidity"] = humidity
        entry["seen"] = ts
    return {
        d: (e["temperature"], e["humidity"], e["seen"]) for d, e in store.items() if e["seen"] + ttl > now
    }


def test_latest_unexpired_edge_cases(spark):
    rows = [
        ("exact", 1, at(0), 1.0, 1.0),
        ("alive", 1, at(1), 1.0, 1.0),
        ("silent", 1, at(-3600 * 2), 5.0, 5.0),
        ("silent", 2, at(3000), None, 6.0),
        ("gap", 1, at(-600), 7.0, 7.0),
        ("gap", 2, at(3000), None, None),
    ]
    df = spark.createDataFrame(rows, READING)
    now = at(3600)
    got = {r.device_id: tuple(r)[1:] for r in telemetry.latest_unexpired(df, F.lit(now)).collect()}
    assert got == store_with_expiry(rows, now, dt.timedelta(hours=1))
    assert "exact" not in got and got["silent"][0] is None and got["gap"] == (None, None, at(3000))


@pytest.mark.parametrize("seed", range(3))
def test_latest_unexpired_replays_the_store(spark, seed):
    rng = random.Random(seed)
    rows = [
        (
            "hot" if rng.random() < 0.5 else f"d{rng.randrange(8)}",
            i,
            at(rng.randrange(0, 20_000, 50)),
            rng.choice([None, None, None, float(i)]),
            rng.choice([None, float(-i)]),
        )
        for i in range(120)
    ]
    for ttl in (600, 1800, 3600):
        now = at(20_100)
        got = telemetry.latest_unexpired(spark.createDataFrame(rows, READING), F.lit(now), f"{ttl} seconds")
        assert {r.device_id: tuple(r)[1:] for r in got.collect()} == store_with_expiry(
            rows, now, dt.timedelta(seconds=ttl)
        )


def test_history_recent_status_windows(spark):
    df = spark.createDataFrame(
        [
            ("d", "p1", 1.0, 2.0, at(0), "online"),
            ("d", "p1", 1.0, 2.0, at(0), "online"),
            ("d", "p2", None, 2.0, at(10), "offline"),
            ("e", "p1", 1.0, 4.0, at(301), None),
        ],
        "device_id string, payload string, temperature double, humidity double, ts timestamp_ntz, status string",
    )
    assert telemetry.history(df).count() == 2
    assert [r.ts for r in telemetry.recent(df, [F.desc("ts")], 2, ["ts"]).collect()] == [at(301), at(10)]
    assert [tuple(r) for r in telemetry.device_status(df, "ts").collect()] == [("d", "offline")]
    windows = telemetry.windowed_readings(df).orderBy("window_start").collect()
    assert [(w.device_id, w.window_start, w.readings, w.avg_temperature) for w in windows] == [
        ("d", at(0), 3, 1.0),
        ("e", at(300), 1, 1.0),
    ]


SAMPLE = "metric string, pod string, container string, namespace string, mode string, instance string, ts timestamp_ntz, value double"


def samples(spark, rows):
    full = [
        (m, pod, c, "default", "idle", pod[-1], at(s), float(v)) for m, pod, c, s, v in rows
    ]
    return spark.createDataFrame(full, SAMPLE)


def test_counter_rate_resets_windows_and_single_samples(spark):
    df = samples(
        spark,
        [
            ("c", "p1", "x", 0, 10),
            ("c", "p1", "x", 60, 16),
            ("c", "p1", "x", 240, 4),
            ("c", "p1", "x", 330, 13),
            ("c", "p1", "x", 1000, 13),
            ("c", "p2", "x", 0, 5),
        ],
    )
    for chunk in (None, "1 minute"):
        rates = metrics.counter_rate(df, ["pod"], chunk=chunk).orderBy("window_start").collect()
        assert [(r.pod, r.window_start, r.increase, r.seconds) for r in rates] == [
            ("p1", at(0), 10.0, 240.0),
            ("p1", at(300), 9.0, 90.0),
            ("p1", at(900), 0.0, 670.0),
        ]
        assert rates[0].rate == pytest.approx(10 / 240)


@pytest.mark.parametrize("chunk", [None, "10 seconds"])
def test_counter_rate_matches_one_window_per_series(spark, chunk):
    rng = random.Random(8)
    rows = [
        ("c", "p1" if rng.random() < 0.7 else f"p{rng.randrange(9)}", "x", s * 0.5, rng.randrange(50))
        for s in range(3000)
    ]
    df = samples(spark, rows)
    by_time = W.partitionBy("pod").orderBy("ts")
    pairs = df.withColumns({"pv": F.lag("value").over(by_time), "pt": F.lag("ts").over(by_time)}).filter("pt is not null")
    want = pairs.groupBy("pod", F.window("ts", "5 minutes").start.alias("window_start")).agg(
        F.sum(F.when(F.col("value") < F.col("pv"), F.col("value")).otherwise(F.col("value") - F.col("pv"))).alias("increase"),
        F.sum(seconds_between("ts", "pt")).alias("seconds"),
    )
    got = metrics.counter_rate(df, ["pod"], chunk=chunk).drop("rate")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_chunk_must_divide_the_window(spark):
    df = samples(spark, [("c", "p1", "x", 0, 1)])
    with pytest.raises(ValueError):
        metrics.counter_rate(df, ["pod"], "5 minutes", chunk="2 minutes")


def test_dashboard_queries(spark):
    df = samples(
        spark,
        [
            ("tx", "p1", "x", 0, 0),
            ("tx", "p1", "x", 100, 50),
            ("tx", "p1", "", 0, 0),
            ("tx", "p1", "", 100, 900),
            ("rx", "p1", "x", 0, 0),
            ("rx", "p1", "x", 50, 100),
        ],
    )
    tx = df.filter("metric = 'tx'")
    busy = metrics.cpu_busy(tx, ["instance", "container"]).first()
    assert busy.cpu_busy == pytest.approx(100 - (0.5 + 9) / 2 * 100)
    workload = F.col("container") != ""
    memory = metrics.gauge_sum_by(tx, ["pod", "container"], ["pod"], where=workload).first()
    assert memory.total == pytest.approx(50 / 1024 / 1024)
    usage = metrics.rate_sum_by(tx, ["pod", "container"], ["pod"], where=workload, scale=100.0).first()
    assert usage.total_rate == pytest.approx(50.0)
    traffic = metrics.tx_rx(df, "tx", "rx", ["pod", "container"], ["pod"]).collect()
    assert {r.direction: r.bytes_per_second for r in traffic} == {"TX": pytest.approx(9.5), "RX": pytest.approx(2.0)}
