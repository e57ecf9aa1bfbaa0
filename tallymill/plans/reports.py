"""The reports on a title table: short calls of the general operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.columns import bucket, main_value
from tallymill.functions.constants import (
    POPULARITY,
    POPULARITY_REST,
    QUALITY,
    QUALITY_REST,
    UNKNOWN,
)
from tallymill.operators.comparing import above_avg, hidden_gems, vs_group_avg
from tallymill.operators.grouping import (
    cross_count,
    decade_trend,
    drop_sentinel,
    group_stats,
    table_summary,
    top_k,
)
from tallymill.operators.ranking import percent_rank_top, row_numbers, top_n_per_group
from tallymill.session import write_once


def main_genre() -> Column:
    return main_value("genres")


def main_country() -> Column:
    return main_value("countries")


def main_director() -> Column:
    return main_value("directors")


def _known(*columns: str) -> Column:
    """None of the columns is the sentinel; NULL is dropped by the comparison."""
    condition = F.col(columns[0]) != UNKNOWN
    for name in columns[1:]:
        condition = condition & (F.col(name) != UNKNOWN)
    return condition


def _best(name: str, *ties: str) -> list[Column]:
    return [F.col(name).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def genre_stats(df: DataFrame) -> DataFrame:
    """Titles, mean score and votes per main genre; the ten largest genres."""
    return group_stats(
        df,
        {"main_genre": main_genre()},
        {
            "movie_count": ("count",),
            "avg_rating": ("avg", "rating_score", 2),
            "total_ratings": ("sum", "rating_count"),
        },
        where=_known("genres"),
        order=_best("movie_count", "main_genre"),
        top=10,
    )


def genre_stats_full(df: DataFrame) -> DataFrame:
    """The same with mean votes and the score range."""
    return group_stats(
        df,
        {"main_genre": main_genre()},
        {
            "movie_count": ("count",),
            "avg_rating": ("avg", "rating_score", 2),
            "avg_votes": ("avg", "rating_count", 0),
            "max_rating": ("max", "rating_score", 1),
            "min_rating": ("min", "rating_score", 1),
        },
        where=_known("genres"),
        order=_best("movie_count", "main_genre"),
        top=10,
    )


def genre_stats_bench(df: DataFrame) -> DataFrame:
    """All genres with mean collections; input from ``prep_bench``."""
    return group_stats(
        df,
        {"genre": main_genre()},
        {
            "cnt": ("count",),
            "avg_score": ("avg", "rating_score", 2),
            "total_votes": ("sum", "rating_count"),
            "avg_collect": ("avg", "collect_count", 0),
        },
        where=_known("genres"),
        order=_best("cnt", "genre"),
    )


def genre_stats_main(df: DataFrame) -> DataFrame:
    """Ten largest main genres; input from ``prep_genre``."""
    return group_stats(
        df,
        ["main_genre"],
        {
            "movie_count": ("count",),
            "avg_rating": ("avg", "rating_score", 2),
            "avg_votes": ("avg", "rating_count", 0),
            "max_rating": ("max", "rating_score", 1),
        },
        order=_best("movie_count", "main_genre"),
        top=10,
    )


def genre_stats_nonnull(df: DataFrame) -> DataFrame:
    """Counts of non-NULL ids and unrounded means; the sentinel is a genre like any other."""
    known = df.dropna(subset=["genres", "rating_score"])
    return group_stats(
        known,
        {"main_genre": main_genre()},
        {
            "movie_count": ("count", "movie_id"),
            "avg_rating": ("avg", "rating_score"),
            "avg_votes": ("avg", "rating_count"),
            "max_rating": ("max", "rating_score"),
        },
        where=F.col("rating_score").between(1.0, 10.0),
        order=_best("movie_count", "main_genre"),
        top=10,
    )


def country_stats(df: DataFrame, min_rows: int = 2) -> DataFrame:
    """Ten best main countries by mean score among those with ``min_rows`` titles."""
    return group_stats(
        df,
        {"main_country": main_country()},
        {
            "movie_count": ("count",),
            "avg_rating": ("avg", "rating_score", 2),
            "max_rating": ("max", "rating_score", 1),
            "total_ratings": ("sum", "rating_count"),
        },
        where=_known("countries"),
        min_rows=min_rows,
        order=_best("avg_rating", "main_country"),
        top=10,
    )


def country_stats_local(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """The same under other names and with a higher group size."""
    return country_stats(df, min_rows).select(
        "main_country",
        "movie_count",
        "avg_rating",
        F.col("total_ratings").alias("total_votes"),
        F.col("max_rating").alias("best_score"),
    )


def director_stats(df: DataFrame, min_rows: int = 2) -> DataFrame:
    """Ten best main directors by mean score among those with ``min_rows`` titles."""
    return group_stats(
        df,
        {"main_director": main_director()},
        {
            "work_count": ("count",),
            "avg_rating": ("avg", "rating_score", 2),
            "best_rating": ("max", "rating_score", 1),
            "total_votes": ("sum", "rating_count"),
        },
        where=_known("directors"),
        min_rows=min_rows,
        order=_best("avg_rating", "main_director"),
        top=10,
    )


def _high_rated(df: DataFrame, score: float, order: list[Column], top: int | None) -> DataFrame:
    return group_stats(
        df,
        {"year": F.col("year").cast("int")},
        {"high_rated_count": ("count",), "avg_rating": ("avg", "rating_score", 2)},
        where=(F.col("year") >= 1950) & (F.col("rating_score") >= score),
        order=order,
        top=top,
    )


def year_high_rated(df: DataFrame, score: float = 9.0) -> DataFrame:
    """Titles of at least ``score`` per year, latest years first."""
    return _high_rated(df, score, [F.col("year").desc()], None)


def year_high_top(df: DataFrame, score: float = 8.5) -> DataFrame:
    """The ten years with most titles of at least ``score``."""
    return _high_rated(df, score, _best("high_rated_count", "year"), 10)


def decade_stats(df: DataFrame) -> DataFrame:
    """Titles, mean score and mean votes per decade, 1930 to 2024."""
    measures = {
        "movie_count": ("count",),
        "avg_rating": ("avg", "rating_score", 2),
        "avg_votes": ("avg", "rating_count", 0),
    }
    return decade_trend(df, "year", measures, 1930, 2025)


def decade_stats_local(df: DataFrame) -> DataFrame:
    """The same with mean collections, 1950 to 2025."""
    measures = {
        "movie_count": ("count",),
        "avg_rating": ("avg", "rating_score", 2),
        "avg_votes": ("avg", "rating_count", 0),
        "avg_collect": ("avg", "collect_count", 0),
    }
    return decade_trend(df, "year", measures, 1950, 2026)


def popularity_quality(df: DataFrame) -> DataFrame:
    """Titles per class of votes and class of score; a missing value is in the lowest class."""
    return cross_count(
        df,
        {
            "popularity": bucket("rating_count", POPULARITY, POPULARITY_REST),
            "quality": bucket("rating_score", QUALITY, QUALITY_REST),
        },
    )


def genre_country(df: DataFrame) -> DataFrame:
    """The fifteen most frequent pairs of main genre and main country."""
    return group_stats(
        df,
        {"genre": main_genre(), "country": main_country()},
        {"cnt": ("count",), "avg_rating": ("avg", "rating_score", 2)},
        where=_known("genres", "countries"),
        order=_best("cnt", "genre", "country"),
        top=15,
    )


def overview(df: DataFrame) -> DataFrame:
    """Titles, mean score, votes and collections of the whole table."""
    return table_summary(
        df,
        {
            "total": ("count",),
            "avg_score": ("avg", "rating_score", 2),
            "total_votes": ("sum", "rating_count"),
            "total_collects": ("sum", "collect_count"),
        },
    )


def above_avg_collect(df: DataFrame) -> DataFrame:
    """Ten most collected titles above the mean collections with a score of 8.5 or more."""
    return above_avg(
        df,
        "collect_count",
        _best("collect_count", "movie_id"),
        where=F.col("rating_score") >= 8.5,
        columns=["title", "year", "rating_score", "collect_count", "rating_count"],
    )


def good_but_overlooked(df: DataFrame) -> DataFrame:
    """Ten best titles over half a point above the mean with fewer votes than the mean."""
    return hidden_gems(
        df,
        "rating_score",
        "rating_count",
        _best("rating_score", "movie_id"),
        columns=["title", "year", "rating_score", "rating_count", "genres"],
    )


def vs_genre_avg(df: DataFrame, votes: int = 50_000) -> DataFrame:
    """Fifteen titles furthest above the mean of their main genre."""
    return vs_group_avg(
        df,
        "genre",
        main_genre(),
        "rating_score",
        _best("above_avg", "movie_id"),
        where=F.col("rating_count") > votes,
        groups_where=_known("genres"),
        columns=["title", "year", "genre", "rating_score", "genre_avg_score", "above_avg", "vs_avg"],
    )


def top3_per_genre(df: DataFrame, votes: int = 1_000) -> DataFrame:
    """Three best titles per main genre, with their rank by score alone."""
    rows = df.filter(_known("genres") & (F.col("rating_count") > votes)).withColumn("main_genre", main_genre())
    best = top_n_per_group(
        rows,
        ["main_genre"],
        [F.col("rating_score").desc_nulls_last()],
        3,
        [F.col("movie_id").asc_nulls_last()],
        row_number="genre_rank",
        rank="rank_in_genre",
    )
    return best.select(
        "main_genre", "title", "rating_score", "rating_count", "genre_rank", "rank_in_genre"
    ).orderBy("main_genre", "genre_rank")


def genre_ranks(df: DataFrame, votes: int = 10_000) -> DataFrame:
    """Three best titles per main genre with rank and percent rank among all of the genre."""
    rows = df.filter(_known("genres") & (F.col("rating_count") > votes)).withColumn("main_genre", main_genre())
    best = top_n_per_group(
        rows,
        ["main_genre"],
        [F.col("rating_score").desc_nulls_last()],
        3,
        [F.col("rating_count").desc_nulls_last(), F.col("movie_id").asc_nulls_last()],
        rank="rank_in_genre",
        percent_rank="pct_rank",
        digits=2,
    )
    return best.select(
        "main_genre", "title", "year", "rating_score", "rating_count", "rn", "rank_in_genre", "pct_rank"
    ).orderBy("main_genre", "rn")


def global_percent_rank(df: DataFrame, votes: int = 10_000) -> DataFrame:
    """Ten best titles with their percent rank among all titles with enough votes."""
    ranked = percent_rank_top(
        df.filter(F.col("rating_count") > votes),
        [F.col("rating_score").desc_nulls_last()],
        [F.col("movie_id").asc_nulls_last()],
        10,
        "percentile",
        digits=3,
    )
    return ranked.select("title", "countries", "year", "rating_score", "rating_count", "percentile")


def genre_row_number(df: DataFrame, votes: int = 5_000, year: int = 2000) -> DataFrame:
    """Every recent title with its place in its main genre by score."""
    rows = df.filter((F.col("rating_count") > votes) & (F.col("year") >= year))
    rows = rows.select("movie_id", "title", "year", "rating_score", main_genre().alias("genre"))
    # Numbering reads its input three times.
    rows = write_once(rows, "ranked-titles")
    numbered = row_numbers(rows, ["genre"], [("rating_score", "desc"), ("movie_id", "asc")])
    return numbered.select("title", "year", "rating_score", "rn")


def top50_titles(df: DataFrame) -> DataFrame:
    """Fifty best titles by score and votes."""
    order = [
        F.col("rating_score").desc_nulls_last(),
        F.col("rating_count").desc_nulls_last(),
        F.col("movie_id").asc_nulls_last(),
    ]
    return top_k(df, order, 50, ["title", "rating_score", "rating_count"])


def genre_known(df: DataFrame) -> DataFrame:
    """Titles with a known genre."""
    return drop_sentinel(df, "genres", UNKNOWN)
