import pytest
from pyspark.sql import functions as F

from tallymill.functions import bucket, decade_label, main_value
from tallymill.functions.constants import QUALITY, QUALITY_REST, UNKNOWN
from tallymill.operators import comparing, grouping, text
from tallymill.plans import pipelines, reports


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_main_value(spark):
    df = spark.createDataFrame([("",), ("a",), ("a/b",), (None,), ("/b",)], "x string")
    assert [r[0] for r in df.select(main_value("x")).collect()] == ["", "a", "a", None, ""]


def test_bucket_puts_null_in_the_rest(spark):
    df = spark.createDataFrame([(9.0,), (8.999,), (None,), (1.0,)], "x double")
    labels = [r[0] for r in df.select(bucket("x", QUALITY, QUALITY_REST)).collect()]
    assert labels == [QUALITY[0][1], QUALITY[1][1], QUALITY_REST, QUALITY_REST]


def test_decade_label(spark):
    df = spark.createDataFrame([(1990,), (1999,), (2000,), (None,)], "y int")
    assert [r[0] for r in df.select(decade_label("y")).collect()] == ["1990s", "1990s", "2000s", None]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0), (None, 9.0), (UNKNOWN, 2.0)], "k string, v double"
    )


def test_group_stats(small):
    out = grouping.group_stats(
        small,
        ["k"],
        {"n": ("count",), "mean": ("avg", "v", 1), "top": ("max", "v")},
        where=F.col("k") != UNKNOWN,
        min_rows=2,
    )
    assert rows(out) == [("a", 2, 2.0, 3.0)]


def test_group_stats_keeps_null_as_a_group(small):
    out = grouping.group_stats(small, ["k"], {"n": ("count",)}, order=[F.desc("n"), F.asc_nulls_last("k")], top=2)
    assert rows(out) == [("a", 2), (None, 2)]


def test_top_value_and_distinct_count(small):
    assert rows(grouping.top_value(small, "k")) == [("a", 2)]
    assert rows(grouping.distinct_count(small, "k")) == [(4,)]
    assert rows(grouping.distinct_count(small, "k", count_null=False)) == [(3,)]
    assert rows(grouping.distinct_count(small.limit(0), "k")) == [(0,)]


def test_table_summary_of_nothing(small):
    assert rows(grouping.table_summary(small.limit(0), {"n": ("count",), "s": ("sum", "v")})) == [(0, None)]


def test_drop_sentinel_drops_null(small):
    assert grouping.drop_sentinel(small, "k", UNKNOWN).count() == 3


def test_cross_count(spark):
    df = spark.createDataFrame([(1, 1.0), (5, None), (5, 9.5)], "a int, b double")
    out = grouping.cross_count(
        df, {"p": bucket("a", [(5, "many")], "few"), "q": bucket("b", QUALITY, QUALITY_REST)}
    )
    assert sorted(rows(out)) == sorted([("few", QUALITY_REST, 1), ("many", QUALITY_REST, 1), ("many", QUALITY[0][1], 1)])


def test_above_avg_uses_the_mean_of_the_whole_table(small):
    out = comparing.above_avg(small, "v", [F.desc("v")], where=F.col("k").isNotNull())
    assert rows(out) == [("b", 5.0)]


def test_hidden_gems(spark):
    df = spark.createDataFrame([(9.0, 10), (9.0, 1000), (1.0, 10), (5.0, 10)], "s double, n int")
    assert rows(comparing.hidden_gems(df, "s", "n", [F.desc("s")])) == [(9.0, 10)]


def test_vs_group_avg(spark):
    df = spark.createDataFrame(
        [("x/y", 4.0, 1), ("x", 5.0, 9), ("x/z", 7.04, 9), ("lone", 9.0, 9), (None, 9.0, 9)],
        "g string, s double, n int",
    )
    out = comparing.vs_group_avg(
        df, "genre", main_value("g"), "s", [F.desc("above_avg")], min_rows=2, where=F.col("n") > 5
    )
    got = [(r.genre, r.genre_avg_score, r.above_avg, r.vs_avg) for r in out.collect()]
    assert got == [("x", 5.35, 1.69, "Above Avg"), ("x", 5.35, -0.35, "Below Avg")]


def test_reports_on_dirty_rows(dirty):
    assert rows(reports.genre_stats(dirty))[0][:2] == ("drama", 5)
    assert reports.director_stats(dirty).count() == 3
    assert rows(reports.year_high_rated(pipelines.prep_analysis(dirty))) == [(2014, 1, 9.4)]


def test_word_count(spark):
    df = spark.createDataFrame([("One, two; TWO a",), (None,), ("",), ("三三，三三 one\none",)], "t string")
    assert rows(text.word_count(df, "t")) == [("one", 3), ("two", 2), ("三三", 2)]
    assert rows(text.word_totals(text.word_count(df, "t"))) == [(7, 3)]
    assert rows(text.word_totals(text.word_count(df.limit(0), "t"))) == [(0, 0)]
    assert rows(text.word_count(df, "t", top=1)) == [("one", 3)]


def test_plain_word_count_splits_like_python(spark):
    lines = ["One, two　Two a ", "  a\tone,\x1cTwo", "", " x\x85y"]
    df = spark.createDataFrame([(line,) for line in lines], "t string")
    expected = {}
    for line in lines:
        for word in line.split():
            expected[word] = expected.get(word, 0) + 1
    assert dict(rows(text.word_count_plain(df, "t"))) == expected


def test_years_are_not_cut(spark):
    df = spark.createDataFrame([(1950 + i, 9.5) for i in range(70)], "year int, rating_score double")
    assert [r.year for r in reports.year_high_rated(df).collect()] == list(range(2019, 1949, -1))
