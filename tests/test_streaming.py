import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallymill.operators import telemetry
from tallymill.session import new_path
from tallymill.sources import read_sensor_stream
from tallymill.streaming import jobs, sinks

T0 = dt.datetime(2024, 1, 1)


def message(device, seq, second, temperature, humidity=1.0, topic="sensors/temperature", arrival=None):
    ts = T0 + dt.timedelta(seconds=second)
    payload = {"device_id": device, "seq": seq, "timestamp": ts.timestamp() if ts.tzinfo else (ts - dt.datetime(1970, 1, 1)).total_seconds()}
    if temperature is not None:
        payload["temperature"] = temperature
    if humidity is not None:
        payload["humidity"] = humidity
    arrived = T0 + dt.timedelta(seconds=second + 1 if arrival is None else arrival)
    return {"topic": topic, "value": json.dumps(payload), "arrival_ts": arrived.isoformat()}


def status(device, state, second):
    arrived = T0 + dt.timedelta(seconds=second)
    value = json.dumps({"device": device, "status": state})
    return {"topic": "sensors/status", "value": value, "arrival_ts": arrived.isoformat()}


BATCHES = [
    [
        message("a", 1, 0, 20.0),
        message("a", 1, 0, 20.0, topic="sensors/humidity"),
        message("b", 1, 10, 30.0, None),
        status("a", "online", 0),
        {"topic": "sensors/temperature", "value": "oops", "arrival_ts": T0.isoformat()},
    ],
    [
        message("a", 3, 120, None, 5.0),
        message("a", 2, 60, 21.0),
        message("a", 1, 0, 20.0, arrival=130),
        status("a", "offline", 200),
        status("b", "online", 150),
    ],
    [
        message("b", 2, 4000, 31.0),
        message("a", 9, 30, 19.0, arrival=4001),
        {"topic": "elsewhere", "value": "{}", "arrival_ts": T0.isoformat()},
    ],
]


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files; each test reads them in this order, one per batch."""
    folder = tmp_path_factory.mktemp("feed")
    for i, batch in enumerate(BATCHES):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(m) for m in batch))
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.fixture
def run(spark, feed):
    topics = ["sensors/temperature", "sensors/humidity", "sensors/status"]

    def start(job, **options):
        root = new_path(spark, "stream-test")
        stream = read_sensor_stream(spark, feed, topics, files_per_batch=1)
        job(stream, f"{root}/out", f"{root}/checkpoint", **options).awaitTermination()
        return f"{root}/out"

    return start


def batch_readings(spark, feed):
    raw = spark.read.schema("topic string, value string, arrival_ts timestamp_ntz").json(feed)
    return telemetry.readings_only(telemetry.good_readings(telemetry.parse_readings(telemetry.topic_filter(raw))))


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_latest_is_the_batch_result_in_spite_of_order(spark, feed, run):
    out = run(jobs.start_latest)
    same(jobs.latest(spark, out), telemetry.latest_by_device(batch_readings(spark, feed)))


def test_unexpired_is_the_batch_result(spark, feed, run):
    out = run(jobs.start_slots, delay="2 hours")
    for second in (100, 3000, 4100, 9000):
        now = F.lit(T0 + dt.timedelta(seconds=second))
        same(jobs.unexpired(spark, out, now), telemetry.latest_unexpired(batch_readings(spark, feed), now))


def test_history_drops_redelivery_across_batches_and_late_rows(spark, run):
    rows = spark.read.parquet(run(jobs.start_history, delay="10 minutes"))
    assert sorted((r.device_id, r.seq) for r in rows.collect()) == [("a", 1), ("a", 2), ("a", 9), ("b", 1), ("b", 2)]
    assert "date" in rows.columns


def test_late_rows_are_kept_aside(spark, run):
    out = run(sinks.start_late_rows, delay_seconds=60)
    late = sinks.late_rows(spark, out).collect()
    assert [(r.device_id, r.seq) for r in late] == [("a", 9)]


def test_a_job_and_its_late_rows(spark, feed):
    root = new_path(spark, "stream-test")
    stream = read_sensor_stream(spark, feed, ["sensors/temperature", "sensors/humidity"], files_per_batch=1)
    for query in jobs.start_with_late_rows(jobs.start_history, stream, f"{root}/out", f"{root}/checkpoint", 60):
        query.awaitTermination()
    assert [(r.device_id, r.seq) for r in sinks.late_rows(spark, f"{root}/out-late").collect()] == [("a", 9)]


def test_snapshots_replace_old_changes(spark, tmp_path):
    """Twelve batches, a snapshot every third: the result is that of all batches, the log stays short."""
    root, folder = new_path(spark, "compaction"), tmp_path / "feed"
    folder.mkdir()
    import os

    for i in range(12):
        path = folder / f"{i:02}.json"
        path.write_text("\n".join(json.dumps(message(d, i, i * 60, float(i * 10 + n))) for n, d in enumerate("abcd") if (i + n) % 3))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_sensor_stream(spark, str(folder), ["sensors/temperature"], files_per_batch=1)
    parsed = telemetry.readings_only(telemetry.good_readings(telemetry.parse_readings(stream)))
    latest = telemetry.latest_by_device(parsed)
    sinks.start_upserts(latest, f"{root}/out", f"{root}/checkpoint", ["device_id"], compact_every=3).awaitTermination()
    same(jobs.latest(spark, f"{root}/out"), telemetry.latest_by_device(batch_readings(spark, str(folder))))
    kept = spark.read.parquet(f"{root}/out/changes").select(sinks.BATCH).distinct().count()
    snapshots = spark.read.parquet(f"{root}/out/snapshots").select(sinks.UPTO).distinct().collect()
    assert kept <= 6 and sorted(r[0] for r in snapshots) == [8, 11]


def test_windows_are_the_batch_result(spark, feed, run):
    out = run(jobs.start_windows, delay="2 hours")
    same(jobs.windows(spark, out), telemetry.windowed_readings(telemetry.distinct_readings(batch_readings(spark, feed))))


def test_status_and_rejects(spark, run):
    states = jobs.status(spark, run(jobs.start_status)).collect()
    assert {r.device_id: r.status for r in states} == {"a": "offline", "b": "online"}
    rejects = spark.read.parquet(run(sinks.start_rejects)).collect()
    assert [r.value for r in rejects] == ["oops"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """New files after a stop: nothing is read twice, nothing old is forgotten."""
    root = new_path(spark, "restart")
    folder = tmp_path / "feed"
    folder.mkdir()

    def deliver(i):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(m) for m in BATCHES[i]))
        stream = read_sensor_stream(spark, str(folder), ["sensors/temperature", "sensors/humidity"])
        jobs.start_history(stream, f"{root}/history", f"{root}/c1", delay="2 hours").awaitTermination()
        jobs.start_latest(stream, f"{root}/latest", f"{root}/c2").awaitTermination()

    for i in range(3):
        deliver(i)
    rows = spark.read.parquet(f"{root}/history").collect()
    assert sorted((r.device_id, r.seq) for r in rows) == [("a", 1), ("a", 2), ("a", 9), ("b", 1), ("b", 2)]
    latest = {r.device_id: (r.temperature, r.humidity) for r in jobs.latest(spark, f"{root}/latest").collect()}
    assert latest == {"a": (21.0, 5.0), "b": (31.0, 1.0)}


def test_a_repeated_batch_replaces_its_rows(spark):
    out = new_path(spark, "repeat")
    for value in (1, 2):
        df = spark.createDataFrame([("d", value)], "device_id string, v int")
        df.write.mode("overwrite").parquet(f"{out}/changes/{sinks.BATCH}=7")
    assert [tuple(r) for r in sinks.current_rows(spark, out, ["device_id"]).collect()] == [("d", 2)]


def test_rolling_latency_goes_on_across_batches(spark, tmp_path):
    """Four batches in order of arrival, a mean over seven readings: the result of one window."""
    from pyspark.sql import Window as W

    root, folder = new_path(spark, "latency"), tmp_path / "feed"
    folder.mkdir()
    for i in range(4):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(message("d", s, s, 1.0, arrival=s + s % 5 / 4)) for s in range(i * 9, i * 9 + 9)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_sensor_stream(spark, str(folder), ["sensors/temperature"], files_per_batch=1)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint", n=7).awaitTermination()
    got = sinks.latencies(spark, f"{root}/out").select("seq", F.round("avg_latency", 9).alias("m"))
    rows = telemetry.latency(batch_readings(spark, str(folder)))
    frame = W.orderBy("arrival_ts", "seq").rowsBetween(-6, 0)
    same(got, rows.select("seq", F.round(F.avg("latency").over(frame), 9).alias("m")))
    assert [r.seq for r in sinks.last_readings(spark, f"{root}/out").orderBy("arrival_ts", "seq").collect()][-1] == 35
    assert sinks.last_readings(spark, f"{root}/out").count() == 7


def test_latency_counts_a_reading_once_per_device(spark, tmp_path):
    """Copies in the same batch, in a later one and with other times between; the mean is per device."""
    folder, root = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    batches = [
        [("a", 1, 0, 2.0), ("b", 1, 0, 5.0), ("a", 1, 0, 3.0)],
        [("a", 2, 1, 7.0), ("a", 1, 0, 7.5), ("b", 1, 0, 7.7)],
        [("a", 1, 0, 9.0), ("b", 2, 4, 10.0), ("a", 3, 8, 11.0)],
    ]
    for i, rows in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(message(d, seq, ts, 1.0, arrival=at)) for d, seq, ts, at in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_sensor_stream(spark, str(folder), ["sensors/temperature"], files_per_batch=1)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint", n=2, keys=["device_id"]).awaitTermination()
    got = {(r.device_id, r.seq): round(r.avg_latency, 9) for r in sinks.latencies(spark, f"{root}/out").collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 4.0, ("a", 3): 4.5, ("b", 1): 5.0, ("b", 2): 5.5}
    assert sinks.latencies(spark, f"{root}/out").count() == 5 and sinks.last_readings(spark, f"{root}/out").count() == 4


def test_latency_forgets_old_copies(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    for i, at in enumerate((0.5, 50.0, 100.0)):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(message("a", seq, 0, 1.0, arrival=at)) for seq in (1, 10 + i)))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_sensor_stream(spark, str(folder), ["sensors/temperature"], files_per_batch=1)
    sinks.start_latency(stream, f"{root}/out", f"{root}/checkpoint", copies_within=60).awaitTermination()
    seen = spark.read.parquet(f"{root}/out/seen").filter("batch_id = 2")
    assert sorted(r["__reading"] for r in seen.collect()) == ["#11", "#12"]
    assert sorted(r.seq for r in sinks.latencies(spark, f"{root}/out").collect()) == [1, 10, 11, 12]
