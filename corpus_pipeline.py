"""A training-data pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Every stage takes what its predecessor kept.  All but the last return the columns
of ``documents``; the last returns the mixture, a row per document with the words
taken from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spriteloom.llm.common import materialize, table
from spriteloom.llm.decontaminate import drop_leaking
from spriteloom.llm.line_frequency import keep_good
from spriteloom.llm.minhash_lines import drop_repeated_lines
from spriteloom.llm.mixture import mix
from spriteloom.llm.simhash_dedup import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The near-duplicate stage needs XXH64, which DuckDB's SQL does not have; the tests compare ``run`` with a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
