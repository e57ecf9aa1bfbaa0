"""Run a job: ``python -m tallymill clean|report|words …`` or the same through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from tallymill.plans import jobs
from tallymill.session import build_session

#: Rows of a result that are printed.
SHOWN = 50


def show(name: str, df: DataFrame) -> None:
    """Print the first rows, and how many there are beyond them."""
    df.persist()
    print(name)
    df.show(SHOWN, truncate=False)
    more = df.count() - SHOWN
    if more > 0:
        print(f"... {more} more rows; --results writes all of them")
    df.unpersist()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallymill")
    parser.add_argument("--master", help="only for runs without spark-submit")
    parser.add_argument("--shared", help="folder that all executors share, for intermediate tables")
    parser.add_argument("--results", help="folder to write every result to, as Parquet")
    commands = parser.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="clean a title file")
    clean.add_argument("inputs", nargs="+", help="paths, the first that exists is read")
    clean.add_argument("--out", required=True)
    clean.add_argument("--steps", choices=list(jobs.STEPS), default="cluster")
    report = commands.add_parser("report", help="reports on a title file")
    report.add_argument("inputs", nargs="+", help="paths, the first that exists is read")
    words = commands.add_parser("words", help="count words")
    words.add_argument("input")
    words.add_argument("--plain", action="store_true", help="keep case and punctuation")
    args = parser.parse_args(argv)

    settings = {"spark.checkpoint.dir": args.shared} if args.shared else {}
    spark = build_session(f"tallymill {args.command}", args.master, **settings)
    if args.command == "clean":
        results = jobs.clean(spark, args.inputs, args.out, args.steps)
    elif args.command == "report":
        results = jobs.report(spark, args.inputs)
    else:
        results = jobs.count_words(spark, args.input, args.plain)
    for name, df in results.items():
        if args.results:
            path = f"{args.results.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(path)
            df = spark.read.schema(df.schema).parquet(path)
        show(name, df)


if __name__ == "__main__":
    main()
