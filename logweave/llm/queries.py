"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import crossentropy, exact, lines, minmax, mixing, packing, quality, resampling, rules, tokengroups, trie, urls, wavelet

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=1024, end_id=2)


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    target = labels.filter((F.col("quality") == 1) & ~quality.held_out(F.col("doc_id")))
    return crossentropy.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=0.02, least_pages=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).drop("text_hash", "copies")


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(urls.host_of(F.col("url")).rlike(urls.LISTED_HOSTS)).select("url")
    return urls.judge_urls(pages, listed, urls.RULES)


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20).drop("text_hash")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), block=100, most=5)


def op13_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokengroups.similarity_join(table(spark, sf_dir, "documents"), width=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minmax_near_dedup": op2_minmax_near_dedup,
    "op3_cross_entropy_difference": op3_cross_entropy_difference,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_systematic_mix": op6_systematic_mix,
    "op7_decision_list": op7_decision_list,
    "op8_url_filter": op8_url_filter,
    "op9_wavelet_tokens": op9_wavelet_tokens,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_group_join": op13_token_group_join,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": lines.ORACLE,
    "op5_exact_dedup": exact.ORACLE,
    "op6_systematic_mix": mixing.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
}
