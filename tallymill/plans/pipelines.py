"""Cleaning pipelines for title tables, and the audit of the rows each step removes.

A pipeline is a list of steps, so the cleaned table and its audit come from one definition.
Expected columns: movie_id, title, original_title, year, rating_score, rating_count, genres,
countries, directors, collect_count, summary; those that are missing are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.columns import is_missing, main_value
from tallymill.functions.constants import (
    DEFAULT_SCORE,
    FIRST_YEAR,
    NO_SUMMARY,
    UNKNOWN,
    UNKNOWN_ORIGINAL_TITLE,
    UNKNOWN_ORIGINAL_TITLE_SHORT,
    UNKNOWN_TITLE,
    UNKNOWN_YEAR,
)
from tallymill.operators import cleaning as c
from tallymill.session import write_once


@dataclass(frozen=True)
class Keep:
    """Keep the rows for which the predicate, built from the rows so far, is true."""

    name: str
    predicate: Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Change:
    """Change columns; the rows stay."""

    apply: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Dedupe:
    """Remove copies."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Store:
    """Write the rows so far to the shared folder, before steps that read them more than once."""

    label: str

    def apply(self, df: DataFrame) -> DataFrame:
        return write_once(df, self.label)


Step = Keep | Change | Dedupe | Store


def run(df: DataFrame, steps: Sequence[Step], store: bool = True) -> DataFrame:
    """Apply the steps. With ``store=False`` nothing is written and the plan stays lazy, at the
    price of repeating the work before each statistic."""
    for step in steps:
        if isinstance(step, Keep):
            df = df.filter(step.predicate(df))
        elif store or not isinstance(step, Store):
            df = step.apply(df)
    return df


def clean_audit(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Rows before and after every step that can remove some."""
    return run_audited(df, steps)[1]


def run_audited(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, and the rows before and after every step that can remove some.

    Both read the same stored tables, so every step that writes one does so once. Counts are passes
    over the columns that the filters use; metrics observed while a table is written would be free, but
    count the rows of a stage again when its output is lost and made anew. Neighbouring filters are counted together in one pass; only a step that reshapes the table
    after a filter, or a de-duplication, starts another pass.
    """
    passes: list[DataFrame] = []
    base, alive = df, F.lit(True)
    counted: list[tuple[int, str, Column]] = [(0, "input", alive)]
    position, filtered = 0, False

    def count_pass() -> None:
        if counted:
            rows = [
                F.struct(F.lit(p).alias("position"), F.lit(n).alias("step"), F.count_if(a).alias("rows_after"))
                for p, n, a in counted
            ]
            passes.append(base.agg(F.array(*rows).alias("r")).select(F.inline("r")))
            counted.clear()

    for step in steps:
        current = base.filter(alive) if filtered else base
        if isinstance(step, Keep):
            position += 1
            alive = alive & F.coalesce(step.predicate(current), F.lit(False))
            filtered = True
            counted.append((position, step.name, alive))
            continue
        if filtered or isinstance(step, Dedupe):
            count_pass()
            alive, filtered = F.lit(True), False
        base = step.apply(current)
        if isinstance(step, Dedupe):
            position += 1
            counted.append((position, step.name, alive))
    count_pass()

    counts = passes[0]
    for more in passes[1:]:
        counts = counts.unionByName(more)
    # One row per step: the window without a partition is as small as the pipeline is long.
    before = F.lag("rows_after").over(Window.orderBy("position"))
    audit = (
        counts.withColumn("rows_before", before)
        .filter(F.col("position") > 0)
        .select("position", "step", "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"))
    )
    return base.filter(alive) if filtered else base, audit


def _fill(values: Mapping[str, object]) -> Change:
    def apply(df: DataFrame) -> DataFrame:
        return c.fill_const(df, {k: v for k, v in values.items() if k in df.columns})

    return Change(apply)


def _present(name: str, column: str) -> Keep:
    return Keep(name, lambda df: ~is_missing(column, df.schema[column].dataType))


def _by_votes(df: DataFrame) -> DataFrame:
    """One row per movie_id: the one with most votes, then most collections, then all other columns."""
    first = [F.col(n).desc_nulls_last() for n in ("rating_count", "collect_count") if n in df.columns]
    return c.dedupe_key(df, ["movie_id"], c.total_order(df, ["movie_id"], first))


_MEAN_SCORE = Change(lambda df: c.fill_mean(df, "rating_score"))
_YEARS = Keep("year", lambda df: c.at_least_or_sentinel("year", FIRST_YEAR, UNKNOWN_YEAR))
_VOTES = Keep("votes_3_sigma", lambda df: c.within_sigma(df, "rating_count"))


def _scores(low: float, high: float) -> Keep:
    return Keep("score_range", lambda df: c.in_range("rating_score", low, high))


CLUSTER_STEPS: list[Step] = [
    _MEAN_SCORE,
    _fill(
        {
            "year": UNKNOWN_YEAR,
            "rating_count": 0,
            "collect_count": 0,
            "movie_id": 0,
            "title": UNKNOWN_TITLE,
            "original_title": UNKNOWN_ORIGINAL_TITLE,
            "genres": UNKNOWN,
            "countries": UNKNOWN,
            "directors": UNKNOWN,
        }
    ),
    Dedupe("whole_row_copies", c.dedupe_rows),
    Store("titles"),
    Change(lambda df: c.cast_columns(df, {"amount": "double", "quantity": "int"})),
    _scores(0.0, 10.0),
    _YEARS,
    _VOTES,
    Change(c.trim_strings),
]

LOCAL_STEPS: list[Step] = [
    _present("year_missing", "year"),
    _MEAN_SCORE,
    _fill(
        {
            "rating_count": 0,
            "collect_count": 0,
            "movie_id": 0,
            "title": UNKNOWN_TITLE,
            "original_title": UNKNOWN_ORIGINAL_TITLE_SHORT,
            "genres": UNKNOWN,
            "countries": UNKNOWN,
            "directors": UNKNOWN,
            "summary": NO_SUMMARY,
        }
    ),
    Dedupe("movie_id_copies", _by_votes),
    Store("titles"),
    # Ids stay BIGINT: at full scale they outgrow INT.
    Change(lambda df: c.cast_columns(df, {"year": "int", "movie_id": "bigint"})),
    _scores(1.0, 10.0),
    _YEARS,
    _VOTES,
    Change(lambda df: c.trim_strings(df, ["title", "genres", "countries", "directors"])),
]

ANALYSIS_STEPS: list[Step] = [
    _MEAN_SCORE,
    _fill(
        {
            "year": UNKNOWN_YEAR,
            "rating_count": 0,
            "collect_count": 0,
            "genres": UNKNOWN,
            "countries": UNKNOWN,
            "directors": UNKNOWN,
            "title": UNKNOWN,
        }
    ),
    Dedupe("movie_id_copies", _by_votes),
    _scores(1.0, 10.0),
]

BENCH_STEPS: list[Step] = [
    _fill(
        {
            "rating_score": DEFAULT_SCORE,
            "rating_count": 0,
            "collect_count": 0,
            "genres": UNKNOWN,
            "countries": UNKNOWN,
            "year": UNKNOWN_YEAR,
        }
    ),
    _scores(1.0, 10.0),
]

GENRE_STEPS: list[Step] = [
    Keep("genre_known", lambda df: F.col("genres") != UNKNOWN),
    _scores(1.0, 10.0),
    Change(lambda df: df.withColumn("main_genre", main_value("genres"))),
]


def clean_cluster(df: DataFrame, store: bool = True) -> DataFrame:
    """Fill scores with their mean and the rest with constants, drop whole-row copies, keep scores
    in 0..10, plausible years and votes within 3 sigma, trim all strings."""
    return run(df, CLUSTER_STEPS, store)


def clean_local(df: DataFrame, store: bool = True) -> DataFrame:
    """Drop rows without a year, fill, keep one row per movie_id, convert, keep scores in 1..10,
    plausible years and votes within 3 sigma, trim the named strings."""
    return run(df, LOCAL_STEPS, store)


def prep_analysis(df: DataFrame) -> DataFrame:
    """Input of the reports: filled, one row per movie_id, scores in 1..10."""
    return run(df, ANALYSIS_STEPS)


def prep_bench(df: DataFrame) -> DataFrame:
    """Constant fills and scores in 1..10, no de-duplication."""
    return run(df, BENCH_STEPS)


def prep_genre(df: DataFrame) -> DataFrame:
    """Known genres and scores in 1..10, with ``main_genre``."""
    return run(df, GENRE_STEPS)
