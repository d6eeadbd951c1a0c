"""Registered queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import (
    op1_resharding,
    op2_quality_rules,
    op3_sentence_spans,
    op4_license_scan,
    op5_best_fit_packing,
    op6_byte_bpe,
    op7_html_labeller,
    op8_fingerprints,
    op9_token_files,
    op10_ngram_join,
    op11_prefix_trie,
    op12_ranked_search,
    op13_decontamination,
)
from wardflow.llm.tables import table


def op1_resharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in shards by their source, which differ much in size; they go to 24 of equal bytes."""
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(24))
    return op1_resharding.shard_documents(spark, table(spark, sf_dir, "documents"), old, 24)


def op2_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_sentence_spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_sentence_spans.deduplicated(table(spark, sf_dir, "documents"))


def op4_license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return op5_best_fit_packing.pack(table(spark, sf_dir, "documents"), path)


def op6_byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return op6_byte_bpe.byte_bpe_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_html_labeller_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return op7_html_labeller.extract(pages, op7_html_labeller.fit(pages))


def op8_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op9_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return op9_token_files.token_files(spark, table(spark, sf_dir, "documents"), path)


def op10_ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = op10_ngram_join.Similarity(n=3, num=90, den=100)
    return op10_ngram_join.jaccard_components(table(spark, sf_dir, "documents"), similarity)


def op11_prefix_trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return op12_ranked_search.ranked_documents(documents, benchmark, k=50)


def op13_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return op13_decontamination.contamination(documents, benchmark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_resharding": op1_resharding_query,
        "op2_quality_rules": op2_quality_rules_query,
        "op3_sentence_spans": op3_sentence_spans_query,
        "op4_license_scan": op4_license_scan_query,
        "op5_best_fit_packing": op5_best_fit_packing_query,
        "op6_byte_bpe": op6_byte_bpe_query,
        "op7_html_labeller": op7_html_labeller_query,
        "op8_fingerprints": op8_fingerprints_query,
        "op9_token_files": op9_token_files_query,
        "op10_ngram_join": op10_ngram_join_query,
        "op11_prefix_trie": op11_prefix_trie_query,
        "op12_ranked_search": op12_ranked_search_query,
        "op13_decontamination": op13_decontamination_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": op2_quality_rules.JUDGE_SQL,
        "op10_ngram_join": op10_ngram_join.COMPONENTS_SQL,
        "op11_prefix_trie": op11_prefix_trie.TRIE_SQL,
        "op12_ranked_search": op12_ranked_search.SEARCH_SQL,
        "op13_decontamination": op13_decontamination.CONTAMINATION_SQL,
    }
