import random

import pytest

from tallymill.plans import catalogue
from tallymill.sources import read_csv, read_csv_split, write_csv

SCHEMA = "id bigint, text string, more string"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_texts():
    rng = random.Random(5)
    pieces = ["plain words", '"', '""', ",", "\n", "\n\n", " ", "é漢", ";", "\\", "\r\n", "a,b", '"quoted"', "'"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(300)]
    return [*texts, "", None, "\n" * 900, 'x"\n' * 400, "long " * 600, "last"]


def test_records_across_splits(spark, tmp_path, small_splits):
    """Quoted newlines at the borders of splits, fields longer than several splits, no text and NULL."""
    rows = [(i, t, None if i % 3 else "m\nn") for i, t in enumerate(odd_texts())]
    path = str(tmp_path / "one")
    write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, multiline=True)
    found = read_csv_split(spark, path, SCHEMA)
    assert sorted(map(tuple, found.collect())) == rows
    assert spark.read.text(path).rdd.getNumPartitions() > 10


def test_same_as_whole_files(spark, tmp_path):
    rows = [(i, t, t) for i, t in enumerate(odd_texts())]
    path = str(tmp_path / "several")
    write_csv(spark.createDataFrame(rows, SCHEMA).repartition(4), path, multiline=True)
    key = lambda r: (r.id, r.text or "")
    assert sorted(read_csv_split(spark, path, SCHEMA).collect(), key=key) == sorted(read_csv(spark, path, SCHEMA, multiline=True).collect(), key=key)


def test_other_files(spark, tmp_path, small_splits):
    """Carriage returns at line ends, empty lines, no line end at the end, fields of the wrong type, a header alone."""
    (tmp_path / "a.csv").write_bytes(b'id,text,more\r\n1,"x\r\ny",z\r\n\r\nno number,b,\r\n3,"","say ""hi"""')
    (tmp_path / "b.csv").write_bytes(b"id,text,more\n")
    (tmp_path / "c.csv").write_bytes(b"")
    found = {r.id: (r.text, r.more) for r in read_csv_split(spark, str(tmp_path / "*.csv"), SCHEMA).collect()}
    assert found == {1: ("x\r\ny", "z"), None: ("b", None), 3: ("", 'say "hi"')}


def test_query_gives_no_task_the_table(spark, tmp_path, small_splits, monkeypatch):
    """The files of the query are bounded, so a larger table is more files."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    tasks = []

    def counted(df, path, **options):
        tasks.append(df.rdd.getNumPartitions())
        write_csv(df, path, **options)

    monkeypatch.setattr(catalogue, "write_csv", counted)
    for limit in (1 << 30, 100_000):
        monkeypatch.setattr(catalogue, "CSV_FILE_BYTES", limit, raising=False)
        found = catalogue.csv_multiline_split(spark, str(tmp_path))
        assert sorted(found.collect()) == sorted(docs.select(found.columns).collect())
    assert tasks[0] == 1 and tasks[1] > 2
