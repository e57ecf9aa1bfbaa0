from pyspark.sql import functions as F

from tallymill import __main__ as command
from tallymill.plans import jobs
from tallymill.session import new_path
from tallymill.sources import write_csv


def test_clean_then_report(spark, dirty):
    root = new_path(spark, "jobs")
    raw = dirty.withColumn("year", F.col("year").cast("double")).withColumn("summary", F.lit('a "b"\nc'))
    write_csv(raw, f"{root}/raw", multiline=True)
    results = jobs.clean(spark, [f"{root}/absent", f"{root}/raw"], f"{root}/clean")
    audit = results["audit"].orderBy("position").collect()
    assert audit[0].rows_before == 11 and audit[-1].rows_after == 8
    assert results["missing"].first().genres == 2  # '' is not NULL
    assert {r.column for r in results["summary"].collect()} == {"rating_score", "rating_count", "year", "collect_count"}
    cleaned = jobs.read_titles(spark, [f"{root}/clean"])
    assert cleaned.count() == 8 and cleaned.select("summary").distinct().collect()[0][0] == 'a "b"\nc'

    made = jobs.report(spark, [f"{root}/clean"])
    assert made["overview"].first().total == 6
    assert made["genres"].first().movie_count == 2
    for df in made.values():
        df.collect()


def test_clean_to_parquet(spark, dirty):
    root = new_path(spark, "jobs")
    dirty.write.parquet(f"{root}/raw.parquet")
    jobs.clean(spark, [f"{root}/raw.parquet"], f"{root}/out.parquet", "local")
    assert spark.read.parquet(f"{root}/out.parquet").count() == 6


def test_words_command(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("one two, Two\none")
    command.main(["words", str(tmp_path / "t.txt")])
    shown = capsys.readouterr().out
    assert "|one |2    |" in shown and "|4          |2             |" in shown
    command.main(["words", "--plain", str(tmp_path / "t.txt")])
    assert "two," in capsys.readouterr().out


def test_every_row_is_written(spark, tmp_path, capsys):
    """Printing stops at some rows and says so; the folder has all of them."""
    (tmp_path / "t.txt").write_text("\n".join(f"w{i:03}" for i in range(9)))
    command.main(["--results", str(tmp_path / "out"), "words", str(tmp_path / "t.txt")])
    assert spark.read.parquet(str(tmp_path / "out/totals")).first().total_words == 9
    capsys.readouterr()
    command.show("many", spark.range(80))
    assert "... 30 more rows" in capsys.readouterr().out


def test_the_raw_file_is_read_once(spark, dirty):
    root = new_path(spark, "jobs")
    raw = dirty.withColumn("year", F.col("year").cast("double")).withColumn("summary", F.lit("s"))
    write_csv(raw, f"{root}/raw", multiline=True)
    results = jobs.clean(spark, [f"{root}/raw"], f"{root}/out")
    for df in results.values():
        assert f"{root}/raw" not in df._jdf.queryExecution().toString()
