from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallymill.session import new_path, shared_dir
from tallymill.sources import (
    literal_rows,
    read_csv,
    read_first,
    read_lines,
    read_table,
    register_view,
    spread,
    synth_table,
    write_csv,
)
from tallymill.sources.tables import SCHEMAS

SCHEMA = "id int, name string, x double"


def test_csv_with_newlines_quotes_spaces_and_nan(spark):
    rows = [(1, 'a "quoted"\nline', 1.5), (2, "  padded ", float("nan")), (3, "", None), (4, None, 2.0)]
    path = new_path(spark, "csv")
    write_csv(literal_rows(spark, rows, SCHEMA), path, multiline=True)
    back = {r.id: r for r in read_csv(spark, path, SCHEMA, multiline=True).collect()}
    assert [back[i].name for i in (1, 2, 3, 4)] == ['a "quoted"\nline', "  padded ", "", None]
    assert back[2].x != back[2].x and back[3].x is None


def test_csv_types_are_inferred_without_a_schema(spark):
    path = new_path(spark, "csv")
    write_csv(spark.range(3).select("id", (F.col("id") / 2).alias("half")), path)
    assert read_csv(spark, path).dtypes == [("id", "int"), ("half", "double")]


def test_read_first_takes_the_first_that_exists(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\ntwo")
    found = read_first(spark, [f"{tmp_path}/absent", f"{tmp_path}/lines.txt"], read_lines)
    assert [r.value for r in found.collect()] == ["one", "two"]
    with pytest.raises(AnalysisException):
        read_first(spark, [f"{tmp_path}/absent"], read_lines)
    with pytest.raises(ValueError):
        read_first(spark, [], read_lines)


def test_read_first_does_not_hide_other_errors(spark, tmp_path):
    def broken(session, path):
        raise RuntimeError("disk")

    with pytest.raises(RuntimeError):
        read_first(spark, ["a", "b"], broken)


def test_views(spark):
    register_view(spark.range(4), "numbers")
    assert spark.sql("select sum(id) from numbers").first()[0] == 6


def test_synthetic_table_repeats(spark):
    first, second = (synth_table(spark, 2000, 4) for _ in range(2))
    assert first.exceptAll(second).count() == 0
    row = first.agg(
        F.min("category"), F.max("category"), F.min("value"), F.max("value"), F.min("quantity"), F.max("quantity"), F.max("flag")
    ).first()
    assert row[0] == 0 and row[1] == 9 and 0 <= row[2] < row[3] < 1000 and (row[4], row[5], row[6]) == (1, 20, 1)


def test_declared_table_schemas_are_those_of_the_files(spark):
    for name in SCHEMAS:
        path = f"/root/testdata/sf0.001/{name}.parquet"
        assert read_table(spark, "/root/testdata/sf0.001", name).dtypes == spark.read.parquet(path).dtypes


def test_spread_only_touches_small_scans(spark):
    small = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide) is wide


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared/x/"}[key]))
    assert shared_dir(named) == "/shared/x"
