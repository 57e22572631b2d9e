"""A training corpus out of ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of their input.

Defined results are those of the stages: null and empty texts are rejected by the
language stage, or, where no document has a label, by the quality rules; rows that repeat
an id and a text leave near-dedup as one; an empty table gives an empty result; extra
columns reach the mixing stage's output and end with the encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelark.llm import bpe, language, mixing, near_dedup, quality_rules
from framelark.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` itself is labelled with."""
    return language.accept(docs, language.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content."""
    return quality_rules.accept(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return near_dedup.accept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of the encoded documents and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("language", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained stages and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spark.read.parquet(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
