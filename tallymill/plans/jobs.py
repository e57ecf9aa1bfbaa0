"""The whole jobs: clean a title file, report on the cleaned titles, count words of a text file."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tallymill.operators.profiling import describe_long, missing_counts, missing_rates
from tallymill.operators.text import word_count, word_count_plain, word_totals
from tallymill.plans import pipelines, reports
from tallymill.session import write_once
from tallymill.sources import read_csv, read_first, read_lines, write_csv

TITLE_SCHEMA = (
    "movie_id bigint, title string, original_title string, year double, rating_score double, "
    "rating_count bigint, genres string, countries string, directors string, collect_count bigint, "
    "summary string"
)

#: Multi-line CSV cannot be split, so its files are kept moderate.
ROWS_PER_FILE = 500_000

STEPS = {
    "cluster": pipelines.CLUSTER_STEPS,
    "local": pipelines.LOCAL_STEPS,
    "analysis": pipelines.ANALYSIS_STEPS,
}

REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "overview": reports.overview,
    "genres": reports.genre_stats_full,
    "countries": reports.country_stats,
    "directors": reports.director_stats,
    "decades": reports.decade_stats_local,
    "high_rated_years": reports.year_high_rated,
    "popularity_quality": reports.popularity_quality,
    "genre_country": reports.genre_country,
    "genre_top_3": reports.genre_ranks,
    "percent_rank": reports.global_percent_rank,
    "versus_genre": reports.vs_genre_avg,
    "most_collected": reports.above_avg_collect,
    "overlooked": reports.good_but_overlooked,
}


def read_titles(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Titles from the first path that exists: Parquet folders by their suffix, CSV otherwise."""

    def read(session: SparkSession, path: str) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return session.read.parquet(path)
        return read_csv(session, path, TITLE_SCHEMA, multiline=True)

    return read_first(spark, paths, read)


def clean(spark: SparkSession, paths: Sequence[str], out: str, steps: str = "cluster") -> dict[str, DataFrame]:
    """Write the cleaned titles to ``out``, as Parquet if it ends in ``.parquet``, else as CSV.

    Returns the profile of the input, the audit and the profile of the result. The input, which
    may be text that cannot be split, is read once; all else reads what was stored of it.
    """
    raw = write_once(read_titles(spark, paths), "raw")
    cleaned, audit = pipelines.run_audited(raw, STEPS[steps])
    if out.rstrip("/").endswith(".parquet"):
        cleaned.write.mode("overwrite").parquet(out)
        written = spark.read.schema(cleaned.schema).parquet(out)
    else:
        write_csv(cleaned, out, multiline=True, rows_per_file=ROWS_PER_FILE)
        written = read_csv(spark, out, cleaned.schema, multiline=True)
    return {
        "missing": missing_counts(raw),
        "missing_percent": missing_rates(raw),
        "audit": audit,
        "summary": describe_long(written, ["rating_score", "rating_count", "year", "collect_count"]),
    }


def report(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """All reports on the prepared titles, which are written once and read by each report."""
    titles = write_once(pipelines.prep_analysis(read_titles(spark, paths)), "prepared")
    return {name: make(titles) for name, make in REPORTS.items()}


def count_words(spark: SparkSession, path: str, plain: bool = False) -> dict[str, DataFrame]:
    """The most frequent words of a text file and, for the cleaned form, totals."""
    lines = read_lines(spark, path)
    if plain:
        return {"words": word_count_plain(lines, "value", top=10)}
    return {"words": word_count(lines, "value", top=20), "totals": word_totals(word_count(lines, "value"))}
