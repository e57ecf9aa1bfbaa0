"""Plans that must hold at scale: pruning, push-down, early reduction, no single-task windows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymill.operators import cleaning, grouping, profiling, ranking, telemetry
from tallymill.plans import reports
from tallymill.sources import read_table, stand_ins

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return read_table(spark, FOLDER, "lineitem")


def test_scan_reads_only_the_columns_used(lineitem):
    text = physical(grouping.group_stats(lineitem, ["l_returnflag"], {"m": ("avg", "l_quantity")}))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text
    assert physical(profiling.summary_stats(lineitem, "l_tax")).count("FileScan") == 1


def test_filters_reach_the_scan(lineitem):
    text = physical(cleaning.filter_range(lineitem, "l_discount", 0.02, 0.04))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_discount,0.02\)", text)


def test_dedupe_reduces_before_the_shuffle(lineitem):
    keys = ["l_orderkey", "l_linenumber"]
    text = physical(cleaning.dedupe_key(lineitem, keys, cleaning.total_order(lineitem, keys)))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)
    assert text.count("Exchange") == 1


def test_top_n_reduces_before_the_shuffle_and_shuffles_once(spark):
    text = physical(reports.top3_per_genre(stand_ins.titles(spark, FOLDER)).select("*"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_profiles_and_audits_do_not_scan_per_column(lineitem):
    assert physical(profiling.missing_counts(lineitem)).count("FileScan") == 1
    assert physical(profiling.describe_long(lineitem)).count("FileScan") == 1


def test_latest_by_device_hashes(spark):
    text = physical(telemetry.latest_by_device(stand_ins.readings(spark, FOLDER)))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_expiry_reduces_before_the_shuffle(spark):
    rows = stand_ins.readings(spark, FOLDER)
    text = physical(telemetry.latest_unexpired(rows, F.lit(datetime(2024, 1, 1))))
    assert "partial_max" in text[text.rindex("Exchange") :]


@pytest.mark.parametrize("name", ["rows", "percent"])
def test_ranks_over_all_rows_never_use_one_partition(lineitem, name):
    if name == "rows":
        df = ranking.row_numbers(lineitem, ["l_returnflag"], [("l_extendedprice", "desc"), ("l_orderkey", "asc")], parts=20)
        text = physical(df)
        assert "SinglePartition" not in text
        assert re.search(r"Exchange hashpartitioning\(l_returnflag#\d+, __c1#\d+, __c2#\d+", text)
    else:
        text = physical(ranking.percent_rank_global(lineitem, "l_extendedprice"))
        # The only single-task window is over the chunks; rows are shuffled once, by chunk and split.
        assert re.search(r"Exchange hashpartitioning\(__chunk#\d+, __split#\d+", text)
        single = text[text.index("SinglePartition") :].splitlines()
        assert "HashAggregate(keys=[__chunk" in single[1]
        assert text.count("SinglePartition") == 1
