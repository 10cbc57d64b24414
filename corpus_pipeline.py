"""From raw documents to packed training sequences, in five stages.

Every stage takes what the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormcell.llm import decontamination, langid, ngram_join, packing, toxicity
from stormcell.llm.common import stage, table

LEAST_LANGUAGE_SCORE = 0.5
TOXIC_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays doubtful, go."""
    model = langid.train(langid.training_rows(docs))
    return langid.keep_known(docs, model, LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=toxicity.TRAIN)
    return toxicity.keep_clean(docs, model, TOXIC_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest doc_id."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates),
          ("decontamination", benchmark), ("packing", pack)]

#: The learned stages can't be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
