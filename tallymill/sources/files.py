"""File sources and sinks. Any URI Spark has a file system for works (``s3a://`` included)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.sources.tables import SCHEMAS


_NULL = "\x00NULL\x00"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header row. Without ``schema`` the types are inferred in an extra pass.

    ``multiline`` accepts quoted newlines and doubled quotes, but Spark cannot split such a
    file: ``write_csv`` has ``rows_per_file`` to keep such files of moderate size, and
    ``read_csv_split`` reads large ones with many tasks.
    """
    # an empty field is NULL and a quoted empty one is '', as NULL is read by a name no text has
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", _NULL)
    if multiline:
        reader = reader.option("multiLine", True).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_split(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Multi-line CSV with a header row in each file, read by as many tasks as the files have splits.

    A line begins a record if the quotes before it in its file are even in number. Quotes are counted per line and
    summed per split, and the sums of the splits before tell a split how it begins. Lines of a
    record are joined again and each record is parsed by itself; only the first and last records
    of the splits, which may go on in another one, are shuffled by record.

    Quotes stand around fields only, and are doubled inside them (what ``write_csv(multiline=True)``
    writes). Lines end with a newline, which may follow a carriage return. As in ``read_csv``, an empty field is NULL and
    a quoted empty one is ''. A line without a character outside quotes is no record. Fields that do not
    fit their type are NULL.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # rises along a split; compared only inside one
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    place = ["file", "split"]
    within = Window.partitionBy(*place).orderBy("at")
    odd = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("odd", odd)

    # a split's records, if it begins outside quotes (0) or inside (1)
    sums = lines.groupBy(*place).agg(
        F.sum("quotes").alias("quotes"), *[F.count_if(F.col("odd") == x).alias(f"starts{x}") for x in (0, 1)]
    )
    earlier = Window.partitionBy("file").orderBy("split")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("own", F.when(F.col("inside") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    sums = sums.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)))
    joined = lines.join(sums.select(*place, "inside", "own", "first"), place)

    begins = (F.col("odd") == F.col("inside")).cast("bigint")
    number = F.col("first") + F.sum(begins).over(within.rowsBetween(Window.unboundedPreceding, 0))
    numbered = joined.withColumn("record", number)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    parts = numbered.groupBy(*place, "record", "first", "own").agg(in_order.alias("text"))

    # the record a split begins in the middle of, and the last one, may have lines elsewhere
    edge = (F.col("record") == F.col("first")) | (F.col("record") == F.col("first") + F.col("own"))
    whole = parts.filter(~edge).select("record", "text")
    split_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "\n")
    cut = parts.filter(edge).groupBy("file", "record").agg(split_order.alias("text")).select("record", "text")
    records = whole.unionByName(cut).filter((F.col("record") > 1) & ~F.col("text").isin("", "\r"))

    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    options = {"nullValue": _NULL, "escape": '"', "mode": "PERMISSIVE"}
    text = F.regexp_replace("text", "\r$", "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    fields = records.select(F.from_csv(text, ddl, options).alias("fields"))
    return fields.select("fields.*")


def write_csv(df: DataFrame, path: str, multiline: bool = False, rows_per_file: int | None = None) -> None:
    """Overwrite ``path`` with CSV files that carry a header row.

    ``multiline`` doubles quotes, the form ``read_csv(multiline=True)`` expects. Spaces at
    the ends of a value survive the round trip, and so does the difference of '' and NULL.
    """
    writer = (
        df.write.mode("overwrite")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if multiline:
        writer = writer.option("escape", '"')
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in one column, ``value``."""
    return spark.read.text(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``; the schema of a known table is not looked up in the files."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain file scan to all cores if the scan has fewer splits than cores.

    For costly work on few files, such as splitting text. Large inputs have more splits than
    cores and are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_first(
    spark: SparkSession,
    paths: Sequence[str],
    read: Callable[[SparkSession, str], DataFrame],
) -> DataFrame:
    """The first of ``paths`` that exists. Any error other than a missing path is raised."""
    missing: AnalysisException | None = None
    for path in paths:
        try:
            return read(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing = error
    if missing is None:
        raise ValueError("read_first needs at least one path")
    raise missing


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """A small table from rows in memory (fixtures)."""
    return spark.createDataFrame(list(rows), schema)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Name ``df`` for SQL and hand it back."""
    df.createOrReplaceTempView(name)
    return df
