import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators import ranking
from tallymill.operators.chunking import add_chunk
from tallymill.operators.joins import join_to_groups


def same_rows(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """4000 rows: one key and one score hold far more than a third each; NULLs and NaN occur."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        score = 5.0 if rng.random() < 0.5 else rng.choice([None, float("nan"), rng.random() * 10, 5.5])
        rows.append((i, key, score, rng.randrange(3)))
    return spark.createDataFrame(rows, "id bigint, k string, s double, t int")


@pytest.mark.parametrize("way", ["asc", "desc"])
@pytest.mark.parametrize("parts", [2, 8, 50])
def test_row_numbers_match_the_window(skewed, way, parts):
    got = ranking.row_numbers(skewed, ["k"], [("s", way), ("id", "asc")], parts=parts)
    score = F.col("s").desc_nulls_last() if way == "desc" else F.col("s").asc_nulls_last()
    want = skewed.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(score, "id")).cast("bigint"))
    same_rows(got, want)


@pytest.mark.parametrize("parts", [3, 40])
def test_row_numbers_by_text(skewed, parts):
    got = ranking.row_numbers(skewed, ["t"], [("k", "asc"), ("id", "desc")], parts=parts)
    order = [F.col("k").asc_nulls_last(), F.col("id").desc()]
    want = skewed.withColumn("rn", F.row_number().over(W.partitionBy("t").orderBy(*order)).cast("bigint"))
    same_rows(got, want)


def test_row_numbers_by_time_and_of_nothing(spark, skewed):
    timed = skewed.withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 997)"))
    got = ranking.row_numbers(timed, ["k"], [("at", "asc"), ("id", "asc")])
    want = timed.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("at", "id")).cast("bigint"))
    same_rows(got, want)
    assert ranking.row_numbers(timed.limit(0), ["k"], [("at", "asc"), ("id", "asc")]).count() == 0


def test_chunks_stay_small_under_skew(skewed):
    """The hot score is alone in its chunk, and the tie-breaker divides that chunk."""
    from tallymill.operators.chunking import add_order_chunks

    cut = add_order_chunks(skewed, [("s", "desc"), ("id", "asc")], ["c1", "c2"], parts=20)
    largest = cut.groupBy("k", "c1", "c2").count().agg(F.max("count")).first()[0]
    assert largest < 4000 / 10


def test_chunk_numbers_rise_with_the_value(spark):
    df = spark.createDataFrame([(v,) for v in [0.5, 1.0, 1.5, 2.0, 9.0, float("nan"), None]], "v double")
    got = [r.c for r in add_chunk(df, F.col("v"), [1.0, 2.0], "c").collect()]
    assert got == [0, 1, 2, 3, 4, 6, None]


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("parts", [1, 2, 9, 200])
def test_percent_rank_global_matches_the_window(skewed, desc, parts):
    got = ranking.percent_rank_global(skewed.repartition(5), "s", desc=desc, out="p", parts=parts)
    order = F.col("s").desc_nulls_last() if desc else F.col("s").asc_nulls_last()
    want = skewed.withColumn("p", F.percent_rank().over(W.orderBy(order)))
    same_rows(got, want)


def test_percent_rank_of_one_row_and_of_text(skewed):
    one = ranking.percent_rank_global(skewed.limit(1), "id", out="p").collect()
    assert [r.p for r in one] == [0.0]
    texts = skewed.select("id", F.concat(F.lit("prefix"), F.col("k"), F.col("id") % 50).alias("x"))
    for column, df in (("k", skewed), ("x", texts)):
        for desc in (True, False):
            got = ranking.percent_rank_global(df, column, desc=desc, out="p", parts=9)
            order = F.col(column).desc_nulls_last() if desc else F.col(column).asc_nulls_last()
            same_rows(got, df.withColumn("p", F.percent_rank().over(W.orderBy(order))))
    with pytest.raises(ValueError):
        ranking.percent_rank_global(skewed.select(F.array("k").alias("a")), "a")


WIDE = {
    "bigint": "9007199254740992 + id % 4",
    "low": "-9223372036854775807 - 1 + id % 3",
    "high": "9223372036854775807 - id % 3",
    "decimal": "cast(12345678901234567890.12 as decimal(38,2)) + cast(id % 5 as decimal(38,2)) / 100",
    "float": "cast(id % 7 / 3 as float)",
    "time": "timestamp_ntz'0001-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 5 / 1000000)",
}


@pytest.mark.parametrize("name", list(WIDE))
def test_values_that_doubles_do_not_tell_apart(spark, name):
    df = spark.range(0, 2000, 1, 7).select("id", F.expr(WIDE[name]).alias("v"))
    for parts in (2, 8):
        got = ranking.percent_rank_global(df, "v", desc=False, out="p", parts=parts)
        same_rows(got, df.withColumn("p", F.percent_rank().over(W.orderBy("v"))))
        got = ranking.row_numbers(df, [], [("v", "desc"), ("id", "asc")], parts=parts)
        same_rows(got, df.withColumn("rn", F.row_number().over(W.orderBy(F.desc("v"), "id")).cast("bigint")))


def test_a_hot_group_ordered_by_text_is_cut(spark):
    from tallymill.operators.chunking import add_order_chunks

    df = spark.range(3000).select(F.lit("hot").alias("k"), F.hex(F.xxhash64("id")).alias("name"), "id")
    cut = add_order_chunks(df, [("name", "asc"), ("id", "asc")], ["c1", "c2"], parts=20)
    assert cut.groupBy("k", "c1", "c2").count().agg(F.max("count")).first()[0] < 3000 / 8


def test_texts_that_begin_alike_are_cut(spark):
    """Borders are whole texts, and a text with many copies is divided by the second column."""
    from tallymill.operators.chunking import add_order_chunks

    name = F.when(F.col("id") % 3 == 0, F.lit("Customer#000000777")).otherwise(F.format_string("Customer#%09d", "id"))
    df = spark.range(6000).select(name.alias("name"), "id").union(spark.createDataFrame([(None, -1), ("é" * 300, -2)], "name string, id bigint"))
    cut = add_order_chunks(df, [("name", "asc"), ("id", "asc")], ["c1", "c2"], parts=20)
    sizes = cut.groupBy("c1", "c2").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 6000 / 20
    got = ranking.row_numbers(df, [], [("name", "asc"), ("id", "asc")], parts=20)
    same_rows(got, df.withColumn("rn", F.row_number().over(W.orderBy(F.col("name").asc_nulls_last(), "id")).cast("bigint")))
    got = ranking.percent_rank_global(df, "name", desc=False, out="p", parts=20)
    same_rows(got, df.withColumn("p", F.percent_rank().over(W.orderBy(F.col("name").asc_nulls_last()))))


@pytest.mark.parametrize("small", [0, 500, 10**6])
def test_only_large_groups_are_cut(skewed, monkeypatch, small):
    monkeypatch.setattr(ranking, "SMALL_GROUP", small)
    for keys in (["k"], ["k", "t"], []):
        got = ranking.row_numbers(skewed, keys, [("s", "desc"), ("id", "asc")])
        order = [F.col("s").desc_nulls_last(), F.col("id")]
        same_rows(got, skewed.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")))


def test_windows_over_counts_stay_short(skewed):
    """No window without partitions but that over the first column's chunks."""
    plan = ranking.row_numbers(skewed, [], [("s", "desc"), ("id", "asc")], parts=50)._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.split("\n") if re.search(r"Window \[", x) and len(re.findall(r"\], \[", x)) == 1]
    assert len(alone) == 1 and re.search(r"\], \[__c1#\d+ ASC NULLS FIRST\]$", alone[0])


def test_percent_rank_top(skewed):
    order = F.col("s").desc_nulls_last()
    got = ranking.percent_rank_top(skewed, [order], [F.col("id").asc()], 700, "p")
    want = (
        skewed.withColumn("p", F.percent_rank().over(W.orderBy(order))).orderBy(order, "id").limit(700)
    )
    same_rows(got, want)


def test_top_n_per_group_ranks_among_all_rows(skewed):
    order = [F.col("s").desc_nulls_last()]
    by_key = W.partitionBy("k").orderBy(*order)
    got = ranking.top_n_per_group(
        skewed, ["k"], order, 40, [F.col("id").asc()], rank="r", percent_rank="p"
    )
    want = (
        skewed.withColumns(
            {
                "rn": F.row_number().over(W.partitionBy("k").orderBy(*order, "id")),
                "r": F.rank().over(by_key),
                "p": F.percent_rank().over(by_key),
            }
        )
        .filter("rn <= 40")
        .select(got.columns)
    )
    same_rows(got, want)


def test_rank_columns(skewed):
    got = ranking.rank_columns(
        skewed, ["t"], {"a": (F.row_number(), [F.col("id")]), "b": (F.percent_rank(), [F.col("id").desc()])}
    )
    ends = got.filter("a = 1").select("b").distinct().collect()
    assert [r.b for r in ends] == [1.0]


@pytest.mark.parametrize("limits", [{}, {"small": 0}, {"small_bytes": 0}])
def test_join_to_groups_finds_every_row_once(spark, skewed, limits):
    groups = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    got = join_to_groups(skewed, groups, ["k"], "n", hot_share=2, **limits)
    last = W.partitionBy("k")
    same_rows(got, skewed.withColumn("last", F.max("id").over(last)))
