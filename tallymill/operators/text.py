"""Word counts over a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.constants import ALL_SPACES, ASCII_SPACES, PUNCTUATION


def words(
    df: DataFrame,
    column: str,
    lower: bool = True,
    separators: str = PUNCTUATION + ASCII_SPACES,
    min_len: int = 2,
) -> DataFrame:
    """One row per word of at least ``min_len`` characters between ``separators``.

    Separators are mapped to spaces character by character, which costs a fraction of a regular
    expression with the same characters.
    """
    text = F.lower(column) if lower else F.col(column)
    text = F.translate(text, separators, " " * len(separators))
    split = df.select(F.explode(F.split(text, " ")).alias("word"))
    return split.filter(F.length("word") >= max(min_len, 1))


def word_count(
    df: DataFrame,
    column: str,
    lower: bool = True,
    separators: str = PUNCTUATION + ASCII_SPACES,
    min_len: int = 2,
    top: int | None = None,
) -> DataFrame:
    """Words and their counts, most frequent first, ties in word order."""
    counts = words(df, column, lower, separators, min_len).groupBy("word").count()
    counts = counts.orderBy(F.desc("count"), F.asc("word"))
    return counts if top is None else counts.limit(top)


def word_count_plain(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of whitespace-separated words as they stand: case and punctuation kept, any length."""
    return word_count(df, column, lower=False, separators=ALL_SPACES, min_len=1, top=top)


def word_totals(counts: DataFrame) -> DataFrame:
    """Total and distinct words of a ``word_count`` without limit."""
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_words"),
        F.count(F.lit(1)).alias("distinct_words"),
    )
