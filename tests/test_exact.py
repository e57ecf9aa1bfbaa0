"""Streams without a watermark, sessions, overlapping windows and the newest readings, against plain windows."""

import datetime as dt
import json
import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_streaming import T0, batch_readings, message, same

from tallymill.operators import metrics, telemetry
from tallymill.plans import pipelines
from tallymill.session import new_path
from tallymill.sources import read_sample_stream, read_sensor_stream
from tallymill.streaming import exact, jobs, sinks

TOPICS = ["sensors/temperature", "sensors/humidity"]


def deliver(folder, batches):
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(batches):
        path = folder / f"{i:03}.json"
        path.write_text("\n".join(json.dumps(m) for m in batch))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def days(n):
    return n * 86_400


@pytest.fixture(scope="module")
def late_feed(tmp_path_factory):
    """Seven batches: copies and new readings that come days and a year late, a batch of copies only, an empty one."""
    first = [message(d, s, days(s) + 30 * s, float(s), None if s % 2 else 2.0) for d in "ab" for s in range(6)]
    return deliver(
        tmp_path_factory.mktemp("late"),
        [
            first,
            [message("a", 400, days(400), 1.5), *first[2:4]],
            [message("a", 401, days(401), None, 3.0), message("b", 7, 45, 9.0), first[0]],
            first,
            [],
            [message("c", 1, days(2), 4.0), message("c", 1, days(2), 4.0, topic="sensors/humidity"), first[5]],
            [message("b", 8, 50, 11.0), message("b", 7, 45, 9.0, arrival=days(500))],
        ],
    )


@pytest.mark.parametrize("merge_every", [2, 3, 20])
def test_nothing_is_lost_and_nothing_counts_twice(spark, late_feed, monkeypatch, merge_every):
    monkeypatch.setattr(exact, "MERGE_EVERY", merge_every)
    out = new_path(spark, "exact")
    stream = read_sensor_stream(spark, late_feed, TOPICS, files_per_batch=1)
    exact.start_readings(stream, out, f"{out}-checkpoint").awaitTermination()
    single = telemetry.distinct_readings(batch_readings(spark, late_feed))
    columns = ["device_id", "seq", "ts", "temperature", "humidity"]
    same(exact.history(spark, out).select(columns), single.where("temperature is not null").select(columns))
    assert exact.history(spark, out).count() == 16
    same(exact.windows(spark, out), telemetry.windowed_readings(single))


def test_a_batch_that_runs_again_replaces_its_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "MERGE_EVERY", 2)
    path = new_path(spark, "again")

    def rows(*values):
        return spark.createDataFrame([(v,) for v in values], "v int")

    def held(before=None):
        return sorted(r.v for r in exact.additions(spark, path, before).collect())

    assert exact.additions(spark, path) is None
    for batch_id in range(6):
        exact.add(rows(batch_id), path, batch_id)
        assert held() == list(range(batch_id + 1))
        exact.add(rows(batch_id), path, batch_id)
        assert held() == list(range(batch_id + 1))
        if batch_id:  # what a repeated batch compares itself with
            assert held(batch_id) == list(range(batch_id))
    kept = spark.read.parquet(f"{path}/added").select(sinks.BATCH).distinct().count()
    assert kept == 2


def test_many_days_in_a_batch(spark, late_feed, monkeypatch):
    monkeypatch.setattr(exact, "MOST_DATES", 1)
    out = new_path(spark, "days")
    exact.start_readings(read_sensor_stream(spark, late_feed, TOPICS, files_per_batch=1), out, f"{out}-checkpoint").awaitTermination()
    assert exact.history(spark, out).count() == 16


def test_only_the_days_of_a_batch_are_read(spark, late_feed):
    out = new_path(spark, "plan")
    exact.start_readings(read_sensor_stream(spark, late_feed, TOPICS, files_per_batch=1), out, f"{out}-checkpoint").awaitTermination()
    stored = exact.additions(spark, f"{out}/readings")
    batch = spark.createDataFrame(stored.where(F.col("date") == F.lit(T0.date())).collect(), stored.schema)
    plan = exact.first_arrivals(batch, stored)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
    assert filters and all(re.search(r"date#\d+ = 2024-01-01", f) for f in filters)


def test_sessions(spark, tmp_path):
    """A gap of exactly the expiry ends a session, one microsecond less does not; copies do not count; open ones wait."""
    hour = 3600
    rows = [message("a", 1, 0, 1.0), message("a", 2, hour - 1e-6, None, 7.0), message("a", 3, 2 * hour - 1e-6, 3.0), message("a", 3, 2 * hour - 1e-6, 3.0)]
    more = [message("a", 4, 6 * hour, 4.0), message("b", 1, 6 * hour, 5.0), message("a", 5, 30 * hour, 6.0)]
    folder, out = deliver(tmp_path / "in", [rows, more]), new_path(spark, "sessions")
    stream = read_sensor_stream(spark, folder, TOPICS, files_per_batch=1)
    jobs.start_sessions(stream, out, f"{out}-checkpoint", "1 hour", "2 hours").awaitTermination()
    got = {(r.device_id, r.readings, r.temperature, r.humidity, r.last_seen) for r in spark.read.parquet(out).collect()}
    at = lambda s: T0 + dt.timedelta(seconds=s)
    assert got == {
        ("a", 2, 1.0, 7.0, at(hour - 1e-6)),
        ("a", 1, 3.0, 1.0, at(2 * hour - 1e-6)),
        ("a", 1, 4.0, 1.0, at(6 * hour)),
        ("b", 1, 5.0, 1.0, at(6 * hour)),
    }
    whole = telemetry.sessions(telemetry.distinct_readings(batch_readings(spark, folder)), "1 hour")
    assert whole.count() == 5 and whole.where("first_seen = last_seen and readings > 1").count() == 0
    assert whole.where("readings = 2").first().humidity == 7.0


SAMPLES = "host string, ts timestamp_ntz, n bigint, value double"


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows = [(h, T0 + dt.timedelta(seconds=rng.randint(0, 2400)), i, float(rng.randint(0, 50))) for i, h in enumerate(["x", "y", None] * 60)]
    return spark.createDataFrame([*rows, ("alone", T0, 999, 1.0)], SAMPLES)


def slow_rates(samples, width, step):
    """Every window by itself: its pairs, summed."""
    series = {}
    for r in samples.collect():
        series.setdefault(r.host, []).append((r.ts, r.n, r.value))
    found = {}
    for host, rows in series.items():
        rows.sort()
        for (t1, _, v1), (t2, _, v2) in zip(rows, rows[1:]):
            begin = T0 + dt.timedelta(seconds=((t2 - T0).total_seconds() // step) * step)
            for k in range(width // step):
                window = found.setdefault((host, begin - dt.timedelta(seconds=k * step)), [0.0, 0.0])
                window[0] += v2 if v2 < v1 else v2 - v1
                window[1] += (t2 - t1).total_seconds()
    return {k: (round(a, 9), round(s, 6), round(a / s, 9)) for k, (a, s) in found.items() if s > 0}


def as_dict(rates):
    return {(r.host, r.window_start): (round(r.increase, 9), round(r.seconds, 6), round(r.rate, 9)) for r in rates.collect()}


@pytest.mark.parametrize(("width", "step"), [(5, 1), (6, 3), (2, 2)])
def test_overlapping_windows(spark, samples, width, step):
    got = metrics.counter_rate_sliding(samples, ["host"], f"{width} minutes", f"{step} minutes", tie="n")
    assert as_dict(got) == slow_rates(samples, width * 60, step * 60)
    assert metrics.counter_rate_sliding(samples.where("false"), ["host"]).collect() == []
    with pytest.raises(ValueError):
        metrics.counter_rate_sliding(samples, ["host"], "5 minutes", "2 minutes")


@pytest.mark.parametrize("merge_every", [2, 20])
def test_counter_rates_go_on_across_batches(spark, samples, tmp_path, monkeypatch, merge_every):
    """Five batches by time, cut in the middle of windows; the fourth brings old samples again."""
    monkeypatch.setattr(exact, "MERGE_EVERY", merge_every)
    rows = sorted(samples.collect(), key=lambda r: (r.ts, r.n))
    cuts = [rows[:30], rows[30:31], rows[31:100], [*rows[100:140], rows[0], rows[35]], rows[140:]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, cut in enumerate(cuts):
        table = pa.table({c: [r[c] for r in cut] for c in ("host", "ts", "n", "value")}, pa.schema([("host", pa.string()), ("ts", pa.timestamp("us")), ("n", pa.int64()), ("value", pa.float64())]))
        pq.write_table(table, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    out = new_path(spark, "rates")
    stream = read_sample_stream(spark, str(folder), samples.schema, files_per_batch=1)
    exact.start_counter_rates(stream, out, f"{out}-checkpoint", ["host"], "5 minutes", tie="n").awaitTermination()
    assert as_dict(exact.counter_rates(spark, out, ["host"])) == slow_rates(samples, 300, 300)
    late = spark.read.parquet(f"{out}/late")
    assert sorted((r.n, r.batch_id) for r in late.collect()) == sorted([(rows[0].n, 3), (rows[35].n, 3)])


@pytest.fixture(scope="module")
def arrivals(spark):
    """Many copies of few readings at the end, ties in the time of arrival, NULLs in time, number and device."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        device, seq = rng.choice(["a", "b", None]), rng.choice([None, *range(40)])
        at = None if i % 50 == 0 else T0 + dt.timedelta(seconds=rng.randint(0, 60))
        rows.append((device, seq, "t", T0, at, float(i % 5), None))
    rows += [("a", 1, "t", T0, T0 + dt.timedelta(seconds=100 + i), 1.0, None) for i in range(80)]
    return spark.createDataFrame(
        rows, "device_id string, seq bigint, topic string, ts timestamp_ntz, arrival_ts timestamp_ntz, temperature double, humidity double"
    )


@pytest.mark.parametrize("n", [1, 5, 20, 60, 1000])
@pytest.mark.parametrize("most", [0, 100_000])
def test_newest_readings(spark, arrivals, monkeypatch, n, most):
    monkeypatch.setattr(telemetry, "MOST_CANDIDATES", most)
    order = Window.orderBy(F.col("arrival_ts").desc_nulls_last(), F.col("seq").desc_nulls_last())
    all_of_them = telemetry.distinct_readings(arrivals).withColumn("place", F.rank().over(order))
    got = telemetry.newest_distinct(arrivals, n)
    assert got.count() == min(n, all_of_them.count())
    # rows that tie for the last places may stand for each other
    positions = lambda df: sorted((str(r.arrival_ts), str(r.seq)) for r in df.collect())
    assert positions(got) == positions(all_of_them.orderBy("place").limit(n))
    assert got.exceptAll(all_of_them.drop("place")).count() == 0
    assert telemetry.newest_distinct(arrivals.where("false"), n).collect() == []


def test_the_history_is_not_shuffled_for_its_newest_readings(spark, arrivals):
    plan = telemetry.newest_distinct(arrivals, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("steps", [pipelines.LOCAL_STEPS, pipelines.CLUSTER_STEPS, pipelines.ANALYSIS_STEPS, pipelines.BENCH_STEPS])
def test_audited_run_is_the_run(spark, dirty, steps):
    cleaned, audit = pipelines.run_audited(dirty, steps)
    same(cleaned, pipelines.run(dirty, steps))
    rows = audit.orderBy("position").collect()
    assert rows[0].rows_before == dirty.count() and rows[-1].rows_after == cleaned.count()
