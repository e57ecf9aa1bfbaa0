"""Quality rules whose cut-offs adapt to language and source.

Each text is measured in one pass. A measure's quantiles come from a sketch of counts in logarithmic
buckets (relative error ``ACCURACY``): sketches merge by adding counts, exactly and in any order, so
they are plain partial aggregates, a repeated task changes nothing and a hot source costs one row per
task and bucket. Groups (language, source) with fewer than ``LEAST_ROWS`` rows use the merged sketch
of their language, and languages with fewer that of the table.

A document fails a measure if it lies beyond ``median + REACH * (q75 - median) + slack`` of its group, or, for
word length, as far below. The slack is the least difference that counts, so that a group in which
nearly every value is equal does not reject its first exception. Shares are held to the least of the
limits of the group, its language and the table, and to ``MOST_SHARE``: a group of which a third is
junk would otherwise allow everything. The thresholds are joined to the
rows by ``join_to_groups``, which measures the table before it broadcasts it.

Defined cases: a NULL or empty text has no words and fails the base rule; NULL languages and sources
are groups of their own; repeated rows count each time; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import SLICE_ROWS
from tallymill.operators.joins import join_null_safe, join_to_groups
from tallymill.session import write_once

WORDS_AT_LEAST = 20
REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
ACCURACY = 0.01
LEAST_ROWS = 100
REACH = 4.0
#: Measure -> (slack, whether low values fail as well).
MEASURES = {
    "symbols_per_word": (0.2, False),
    "dup_line_share": (0.4, False),
    "repeat_share": (0.25, False),
    "mean_word": (1.0, True),
}
#: Measures of which 1 is all of a text, and what no group's limit exceeds.
SHARES = ("dup_line_share", "repeat_share")
MOST_SHARE = 0.9
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
    ordered = np.sort(mixed)
    same = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(same):
        return 0
    at = np.flatnonzero(np.isin(mixed, same)).tolist()
    # equal hashes are not yet equal words
    windows = [tuple(words[i : i + window]) for i in at]
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if times[w] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, lang, source and the counts, one row per row of ``df``."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *[F.col(f"`{c}`").cast("string").alias(name) for c, name in zip(group_cols, ("lang", "source"), strict=True)],
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                counts = np.array([measure(t) for t in part.column(3).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(counts[:, i]) for i in range(len(_COUNTS))]], ["doc_id", "lang", "source", *_COUNTS]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def measures(counts: DataFrame) -> dict[str, Column]:
    return {
        "symbols_per_word": F.try_divide("n_symbols", "n_words"),
        "dup_line_share": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_share": F.try_divide("n_repeat_words", "n_words"),
        "mean_word": F.try_divide("word_chars", "n_words"),
    }


_STEP = log((1 + ACCURACY) / (1 - ACCURACY))


def sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, measure, bucket, n: a quantile sketch per group and measure. Values are 0 or more; NULL is not counted."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("x")) for name, value in values.items()]))
    # bucket b holds the values in (base^(b-1), base^b]; the lowest bucket is for 0
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.ln("v.x") / _STEP)).otherwise(F.lit(-(1 << 31)).cast("bigint"))
    return (
        rows.select(*keys, each.alias("v"))
        .where("v.x is not null")
        .groupBy(*keys, F.col("v.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of the union of all groups that agree in ``keys``."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys, measure, n and one column per wanted quantile (its bucket's middle)."""
    group = Window.partitionBy(*keys, "measure")
    rows = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("bucket") > -(1 << 31), F.exp((F.col("bucket") - 0.5) * _STEP)).otherwise(0.0)
    # ranks are compared as whole numbers, so engines that round differently agree
    found = [
        F.min(F.when(F.col("upto") * 1000 >= F.col("total") * int(1000 * q), value)).alias(name) for name, q in wanted.items()
    ]
    return rows.groupBy(*keys, "measure").agg(F.max("total").alias("n"), *found)


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, n_rows and low_/high_ limits per measure, for every group of ``rows``."""
    keys = ["lang", "source"]
    fine = write_once(sketch(rows, keys, measures(rows)), "sketches")
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    levels = [
        quantiles(fine, keys, wanted),
        quantiles(merge(fine, ["lang"]), ["lang"], wanted),
        quantiles(merge(fine, []), [], wanted),
    ]
    own, language, everything = (
        x.withColumnsRenamed({c: f"{c}_{i}" for c in ("n", *wanted)}) for i, x in enumerate(levels)
    )
    both = join_null_safe(own, language, ["lang", "measure"]).join(F.broadcast(everything), "measure")

    def chosen(c: str) -> Column:
        return F.when(F.col("n_0") >= LEAST_ROWS, F.col(f"{c}_0")).when(F.col("n_1") >= LEAST_ROWS, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))

    limits = []
    for name, (slack, low) in MEASURES.items():
        mine = F.col("measure") == name
        high = chosen("q50") + REACH * (chosen("q75") - chosen("q50")) + slack
        if name in SHARES:
            of_language, of_table = (F.col(f"q50_{i}") + REACH * (F.col(f"q75_{i}") - F.col(f"q50_{i}")) + slack for i in (1, 2))
            high = F.least(high, F.when(F.col("n_1") >= LEAST_ROWS, of_language), of_table, F.lit(MOST_SHARE))
        limits.append(F.max(F.when(mine, high)).alias(f"high_{name}"))
        if low:
            limits.append(F.max(F.when(mine, chosen("q50") - REACH * (chosen("q50") - chosen("q25")) - slack)).alias(f"low_{name}"))
    return both.groupBy(*keys).agg(F.max("n_0").alias("n_rows"), *limits)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept."""
    rows = write_once(measured(df, id_col, text_col, group_cols), "measured")
    # groups without any word have no thresholds and fail the base rule
    with_words = join_to_groups(rows.where("n_words > 0"), thresholds(rows), ["lang", "source"], size="n_rows")
    values = measures(rows)
    good = F.lit(True)
    for name, (_, low) in MEASURES.items():
        good = good & (values[name] <= F.col(f"high_{name}"))
        if low:
            good = good & (values[name] >= F.col(f"low_{name}"))
    failed = (F.col("n_words") < WORDS_AT_LEAST) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    names = ["doc_id", "lang", "source", *_COUNTS]
    judged = with_words.select(*names, failed.alias("base_failed"), (~failed & good).alias("kept"))
    wordless = rows.where("n_words = 0").select(*names, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"))
    return judged.unionByName(wordless)
