"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The mean repetition rate of a source is what brings its expected share of all characters to its
weight: ``rate = weight * total / characters of the source``. Each document is repeated as often as
the inverse of the Poisson distribution with that mean says at a number in [0, 1) hashed from the
seed and the id, so a run, a retried task and another cluster layout agree. The copies are exploded
and shuffled globally by a second hash: it deals each copy to a partition and orders it there.

The distribution function of a source is one array, made once per source by summing probabilities
in logarithms, long enough that what lies beyond is under 1e-15. A second array says how many of its
values lie below each of as many equal parts of [0, 1], so a document compares its number with the few
values of one part.
Sources are counted with partial aggregates; their table is joined by ``join_to_groups``, which
broadcasts it only after measuring it and otherwise keeps a hot source out of the shuffle.

Defined cases: a NULL source is a source of its own; a source without a weight (or with weight zero,
or without any text) gives no copies; weights are scaled to one over the sources present; a NULL
text counts no characters, and a source of only empty texts is weighed by rows instead; a row
without an id is hashed by its text; repeated rows are repeated alike; ``copy`` counts from 0 and
``mix_key`` is the shuffled place; input columns of these two names make way; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import replace_columns
from tallymill.operators.joins import join_to_groups
from tallymill.session import write_once

SEED = 8
#: Without given weights: a source's share of the characters to this power.
TEMPERATURE = 0.7


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash, with 52 bits."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def poisson_tables(groups: DataFrame) -> DataFrame:
    """``groups`` (_tm_source, n_rows, rate) with, in place of the rate, the source's distribution.

    ``_tm_cdf`` holds P(X <= 0), P(X <= 1), ... up to where the rest is below 1e-15, and ``_tm_before``
    how many of these lie at or below 0, 1 / parts, 2 / parts, ..., 1, with a power of two of parts.
    Logarithms of ratios are added up by windows, so the cost is in proportion to the rate.
    """
    last = F.ceil(F.col("rate") + 9 * F.sqrt("rate") + 20).cast("int")
    parts = F.pow(F.lit(2), F.ceil(F.log2(last + F.lit(1)))).cast("int")
    steps = groups.withColumns({"_tm_parts": parts, "_tm_k": F.explode(F.sequence(F.lit(0), last))})
    ratio = F.when(F.col("_tm_k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln(F.col("_tm_k").cast("double")))
    # a source's steps are as many as its rate asks for, however many documents it has
    upto = Window.partitionBy("_tm_source").orderBy("_tm_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_tm_p", F.exp(F.sum(ratio).over(upto))).withColumn("_tm_at", F.sum("_tm_p").over(upto))
    marks = steps.select("_tm_source", F.posexplode(F.when(F.col("_tm_k") == 0, F.sequence(F.lit(0), F.col("_tm_parts")))).alias("_tm_mark", "_tm_i"), "_tm_parts")
    marks = marks.select("_tm_source", "_tm_mark", (F.col("_tm_mark") / F.col("_tm_parts").cast("double")).alias("_tm_at"))
    both = steps.select("_tm_source", F.lit(None).cast("int").alias("_tm_mark"), "_tm_at", "n_rows").unionByName(marks, allowMissingColumns=True)
    below = Window.partitionBy("_tm_source").orderBy("_tm_at", F.col("_tm_mark").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_tm_n", F.count_if(F.col("_tm_mark").isNull()).over(below).cast("int"))
    before = F.array_sort(F.collect_list(F.when(F.col("_tm_mark").isNotNull(), F.struct("_tm_mark", "_tm_n"))))
    return counted.groupBy("_tm_source").agg(
        F.max("n_rows").alias("n_rows"),
        F.array_sort(F.collect_list(F.when(F.col("_tm_mark").isNull(), F.col("_tm_at")))).alias("_tm_cdf"),
        F.transform(before, lambda x: x["_tm_n"]).alias("_tm_before"),
    )


def quantile(cdf: Column, before: Column, u: Column) -> Column:
    """How many entries of a source's distribution lie at or below ``u``: those before its part, and what the part has."""
    part = F.floor(u * (F.size(before) - 1)).cast("int")
    known = F.get(before, part)
    inside = F.slice(cdf, known + 1, F.get(before, part + 1) - known)
    return known + F.size(F.filter(inside, lambda c: c <= u))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """_tm_source, n_rows, rate: one row per source that is to be repeated."""
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("_tm_source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).cast("bigint")).alias("chars")
    )
    sizes = sizes.withColumn("size", F.when(F.col("chars") > 0, F.col("chars")).otherwise(F.col("n_rows")))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("_tm_source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
    sizes = write_once(sizes, "sources")
    present = sizes.where("weight > 0")
    # sums of doubles in the order of the sources, so that every run has the same rates
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_tm_source", "weight"))), lambda x: x["weight"])
    weights_sum = present.agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x)).scalar()
    total = sizes.agg(F.sum("size").cast("double")).scalar()
    return present.select("_tm_source", "n_rows", (F.col("weight") / weights_sum * total / F.col("size")).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """The columns of ``docs``, copy and mix_key: each document as often as its source asks, in random order."""
    groups = poisson_tables(rates(docs, weights, source_col, text_col))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))
    keyed = docs.withColumns({"_tm_source": F.col(f"`{source_col}`"), "_tm_row": row})
    joined = join_to_groups(keyed, groups, ["_tm_source"], size="n_rows")
    u = uniform(F.lit(str(seed)), F.lit("count"), F.col("_tm_row"))
    times = joined.withColumn("_tm_u", u)
    times = times.withColumn("_tm_times", quantile(F.col("_tm_cdf"), F.col("_tm_before"), F.col("_tm_u"))).where("_tm_times > 0")
    copies = times.withColumn("_tm_copy", F.explode(F.sequence(F.lit(0), F.col("_tm_times") - 1)))
    key = uniform(F.lit(str(seed)), F.lit("place"), F.col("_tm_row"), F.col("_tm_copy").cast("string"))
    placed = replace_columns(copies, copy=F.col("_tm_copy"), mix_key=key)
    kept = [c for c in placed.columns if not c.startswith("_tm_")]
    return placed.select(*[f"`{c}`" for c in kept]).repartition("mix_key").sortWithinPartitions("mix_key")
