"""A corpus pipeline: five stages over whole documents, each reading what the one before it kept.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each group of documents linked by shingle similarity one stays.
3. decontaminate: documents in which a benchmark window occurs go.
4. pii: personal data in the texts is replaced by its kind; ``n_chars`` follows.
5. mix: every document gets its place in a mix of the sources by tempered weights.

Each stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns as its
operator does: null and empty texts score low and go with the first stage; of rows that repeat an id and a text the second
keeps one, and rows without an id all stay; of equal texts the one with the smallest id stays; a further column stays with
its row, whatever its name, to the end, where ``mix_block``, ``mix_slot`` and ``mix_position`` are added in place of any of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import decontaminate as leaks
from docketry.llm import jaccard, mixing, pii, quality
from docketry.llm._shared import stored, table
from docketry.sources.scratch import bounded


def sized(spark: SparkSession) -> None:
    """Small batches also where a stage's result is written by whoever called it: rows of long texts stay few in memory."""
    for name, value in bounded().items():
        spark.conf.set(name, value)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized(spark)
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized(spark)
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized(spark)
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized(spark)
    return mixing.mixed(docs, mixing.tempered(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
]

#: Neither the classifier nor the random field can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
