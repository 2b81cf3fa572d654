"""The corpus pipeline: quality, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; its
result is written as Parquet and reread. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import staged
from strata.llm.exact_dedup import drop_exact_duplicates
from strata.llm.ngram_join import drop_near_duplicates
from strata.llm.packing import packed_sequences
from strata.llm.pii import redact
from strata.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("pii", private), ("best_fit_packing", packing)]
#: The classifier, the span model and the tokenizer are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
