"""From raw documents to packed training sequences, in four stages.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of documents. What a stage removes
is gone for the stages after it; NULL, empty and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardflow.llm import op2_quality_rules, op3_sentence_spans, op5_best_fit_packing, op10_ngram_join
from wardflow.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return op2_quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 5-grams, Jaccard similarity of 0.8 or more."""
    return op10_ngram_join.keep_one(docs, op10_ngram_join.Similarity(n=5, num=80, den=100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return op3_sentence_spans.remove_repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 1024."""
    return op5_best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

# Token ids come from a tokenizer, which SQL does not have; the tests hold run() against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
