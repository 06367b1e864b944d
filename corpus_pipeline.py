"""The training-data pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and rereads as the next one's ``docs``.
All but the last return the columns of ``documents``.

Cases, in every stage: documents with null or empty texts, or without a letter, go
in the first one, which knows no language for them; rows that repeat go on as rows
of the same document until the join keeps one of each group; null ids and sources
are ids and sources of their own, last in order; texts of any length are read
whole; extra columns, whatever their names, go through all stages but the last; an
empty table gives an empty result.

The stages learn, sample at random by hash, and pack by a tokenizer, which SQL
cannot express: ``ORACLE_SQL`` is None, and the tests hold the pipeline against
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import language_id, line_dedup, mixing, ngram_join, packing
from prosemill.llm.common import prepare, read_table, store

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    return language_id.language_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines."""
    return line_dedup.line_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.join_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until each source has its target."""
    return mixing.mix_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    return packing.pack_stage(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
