import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallymill.functions.constants import UNKNOWN, UNKNOWN_TITLE
from tallymill.operators import cleaning, profiling
from tallymill.plans import pipelines


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_missing_counts_see_null_and_nan_but_not_text(spark, dirty):
    row = profiling.missing_counts(dirty).first()
    assert row.movie_id == 1
    assert row.rating_score == 1
    assert row.genres == 2
    assert row.year == 1
    text = spark.createDataFrame([("NaN",), (None,), ("x",)], "t string")
    assert profiling.missing_counts(text).first().t == 1
    assert profiling.missing_counts(text, text_nan=True).first().t == 2


def test_missing_counts_on_every_type(spark):
    df = spark.sql("select array(1) a, true b, timestamp_ntz'2020-01-01 00:00:00' t, date'2020-01-01' d, 'x' s")
    assert set(profiling.missing_counts(df).first()) == {0}


def test_missing_rates(spark, dirty):
    row = profiling.missing_rates(dirty).first()
    assert row.genres == pytest.approx(200 / 11)
    assert profiling.missing_rates(dirty.limit(0)).first().genres is None


def test_drop_missing_drops_nan_too(dirty):
    assert cleaning.drop_missing(dirty, ["year"]).count() == 10
    assert cleaning.drop_missing(dirty, ["rating_score"]).count() == 10


def test_fill_const(dirty):
    filled = cleaning.fill_const(dirty, {"rating_score": 6.0, "title": UNKNOWN_TITLE, "year": 0})
    assert filled.filter(F.isnan("rating_score")).count() == 0
    assert filled.filter(F.col("title") == UNKNOWN_TITLE).count() == 1
    with pytest.raises(AnalysisException):
        cleaning.fill_const(dirty, {"nowhere": 1}).collect()


def test_fill_mean_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (float("nan"),)], "x double")
    assert sorted(values(cleaning.fill_mean(df, "x"), "x")) == [1.0, 2.5, 2.5, 4.0]


def test_fill_mean_keeps_a_mean_of_zero_and_falls_back_without_values(spark):
    zero = spark.createDataFrame([(-1.0,), (1.0,), (None,)], "x double")
    assert sorted(values(cleaning.fill_mean(zero, "x"), "x")) == [-1.0, 0.0, 1.0]
    nothing = spark.createDataFrame([(None,), (None,)], "x double")
    assert values(cleaning.fill_mean(nothing, "x"), "x") == [6.0, 6.0]
    assert cleaning.fill_mean(nothing.limit(0), "x").count() == 0


def test_dedupe_rows(dirty):
    assert cleaning.dedupe_rows(dirty).count() == 10


def test_dedupe_key_keeps_the_first_in_order_and_joins_null_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (None, 1), (None, 2), (2, 7)], "k int, v int")
    out = cleaning.dedupe_key(df, ["k"], cleaning.total_order(df, ["k"], [F.col("v").desc()]))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 9), (None, 2), (2, 7)], key=str)


def test_filters(dirty):
    assert cleaning.filter_range(dirty, "rating_score", 0, 10).count() == 9
    assert cleaning.filter_range(dirty, "rating_score", 1, 10).count() == 8
    years = cleaning.filter_min_or_sentinel(cleaning.fill_const(dirty, {"year": 0}), "year", 1888, 0)
    assert sorted(set(values(years, "year")))[:2] == [0, 1888]
    assert 1871 not in values(years, "year")


def test_filter_sigma_needs_enough_rows_to_reject_one(spark):
    def kept(rows):
        df = spark.createDataFrame([(float(v),) for v in rows], "x double")
        return cleaning.filter_sigma(df, "x").count()

    assert kept([1] * 9 + [1000]) == 10
    assert kept([1] * 19 + [1000]) == 19
    assert kept([5]) == 1
    assert kept([5, 5, 5]) == 3


def test_filter_sigma_clamps_the_lower_bound_and_drops_null(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (None,)], "x double")
    assert sorted(values(cleaning.filter_sigma(df, "x"), "x")) == [0.0, 5.0]
    assert sorted(values(cleaning.filter_sigma(df, "x", floor=None), "x")) == [-5.0, 0.0, 5.0]


def test_cast_columns_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("12", "3.5"), ("x", "y")], "quantity string, amount string")
    out = cleaning.cast_columns(df, {"quantity": "int", "amount": "double", "absent": "int"})
    assert [tuple(r) for r in out.collect()] == [(12, 3.5), (None, None)]


def test_trim_strips_spaces_only(spark):
    df = spark.createDataFrame([("  a ", "\tb\t"), ("　c　", None)], "x string, y string")
    assert [tuple(r) for r in cleaning.trim_strings(df).collect()] == [("a", "\tb\t"), ("　c　", None)]
    assert values(cleaning.trim_strings(df, ["y"]), "x")[0] == "  a "


def test_summary_and_describe(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0), (5, None)], "a int, b double")
    row = profiling.summary_stats(df, "a").first()
    assert (row.mean, row.stddev, row.min, row.max) == (3.0, 2.0, 1, 5)
    described = {r.column: r for r in profiling.describe_long(df).collect()}
    assert described["b"]["count"] == 2
    assert described["b"].stddev == pytest.approx(math.sqrt(2))
    texts = {r.column: r for r in profiling.describe_long(spark.createDataFrame([("b",), ("a",), (None,)], "t string")).collect()}
    assert (texts["t"]["count"], texts["t"].first, texts["t"].last, texts["t"].mean) == (2, "a", "b", None)
    one = profiling.summary_stats(df.limit(1), "a").first()
    assert one.stddev is None


def test_schema_report(dirty):
    rows = {r.name: r.type for r in profiling.schema_report(dirty).collect()}
    assert rows["movie_id"] == "bigint" and rows["rating_score"] == "double"


def test_clean_cluster(dirty):
    out = {r.title: r for r in pipelines.clean_cluster(dirty).collect()}
    assert "Void" not in out and "Early" not in out
    assert set(out) == {"Harbour", "Lantern", "Dim", "Crowd", UNKNOWN_TITLE, "First", "Unscored"}
    scores = [8.2, 8.2, 7.2, 7.2, -2.5, 0.7, 9.4, 7.8, 6.4, 6.4]
    assert out["Unscored"].rating_score == pytest.approx(sum(scores) / 10)
    assert out["Unscored"].movie_id == 0
    assert out[UNKNOWN_TITLE].genres == UNKNOWN
    assert pipelines.clean_cluster(dirty).count() == 8  # two different rows for movie 2


def test_clean_local(dirty):
    out = {r.title: r for r in pipelines.clean_local(dirty).collect()}
    assert set(out) == {"Harbour", "Lantern", "Crowd", UNKNOWN_TITLE, "First", "Unscored"}
    assert out["Lantern"].rating_count == 4000
    scores = [8.2, 8.2, 7.2, 7.2, 0.7, 9.4, 7.8, 6.4, 6.4]
    assert out["Unscored"].rating_score == pytest.approx(sum(scores) / 9)
    lazy = pipelines.clean_local(dirty, store=False)
    assert lazy.exceptAll(pipelines.clean_local(dirty)).count() == 0


@pytest.mark.parametrize("steps", [pipelines.CLUSTER_STEPS, pipelines.LOCAL_STEPS, pipelines.ANALYSIS_STEPS])
def test_audit_matches_the_pipeline(dirty, steps):
    rows = pipelines.clean_audit(dirty, steps).orderBy("position").collect()
    assert rows[0].rows_before == dirty.count()
    for before, after in zip(rows, rows[1:]):
        assert before.rows_after == after.rows_before
    assert rows[-1].rows_after == pipelines.run(dirty, steps).count()
    assert all(r.removed == r.rows_before - r.rows_after >= 0 for r in rows)


def test_audit_of_an_empty_table(dirty):
    rows = pipelines.clean_audit(dirty.limit(0), pipelines.LOCAL_STEPS).collect()
    assert len(rows) == 5 and all(r.rows_before == r.rows_after == 0 for r in rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3) | st.none(), st.integers(-5, 5) | st.none()), max_size=30))
def test_dedupe_is_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "k int, v int")
    order = cleaning.total_order(df, ["k"])
    once = cleaning.dedupe_key(df, ["k"], order)
    twice = cleaning.dedupe_key(once, ["k"], order)
    expected = {}
    for k, v in rows:
        best = expected.get(k, (True, 0))
        expected[k] = min(best, (v is None, v or 0)) if k in expected else (v is None, v or 0)
    got = {r.k: r.v for r in once.collect()}
    assert got == {k: None if missing else v for k, (missing, v) in expected.items()}
    assert {r.k: r.v for r in twice.collect()} == got
