"""A corpus from raw documents to packed sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import mixing, packing, pii, quality, simhash
from tallymill.llm.common import read
from tallymill.llm.tokens import vocabulary
from tallymill.session import write_once


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a fifth of the labels stays unseen, to measure it by.

    A NULL or empty text has a score as any other; rows without an id, or without a label, are scored
    but not learned from; repeated rows get the same score; without labels of both kinds
    every score is the share of the good ones; an empty table gives an empty one.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    labels = labels.where(quality.crc_fold(F.col("doc_id")) != 0)
    scored = quality.with_score(docs, quality.train(docs, labels))
    return scored.where(F.col("_tm_score") >= quality.THRESHOLD).drop("_tm_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: texts that share 0.8 of their five-word shingles.

    It is the one with the smallest id, then the smallest text; a row without an id stays only where no
    member has one. NULL, empty and blank texts have
    no words and are copies of each other; fewer words than five are one shingle; rows that share an id
    are told apart by their texts; an empty table gives an empty one.
    """
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows.

    A NULL text stays NULL, with n_chars NULL; repeated rows are redacted alike; a table without any
    example of a kind has its base spans replaced only; an empty table gives an empty one.
    """
    return pii.redacted(docs, pii.train(docs), length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to even out the sources, and shuffled.

    A NULL source is a source of its own; a NULL text counts no characters; rows without an id are drawn
    by their text; repeated rows are repeated alike; an empty table gives an empty one.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in windows of 2048.

    A NULL or empty text is the end id alone; repeated rows are packed each; longer texts are cut into
    full windows first; an empty table gives no piece.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", redact), ("mix", mix), ("pack", pack)]

#: The fingerprints use XXH64, the classifier and the span model are trained: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
