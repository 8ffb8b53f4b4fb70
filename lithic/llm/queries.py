"""The queries of the corpus operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import fingerprints, hard_negatives, jaccard_join, line_templates, merkle, mixing, piece_codec, sharding, suffix_dedup, tool_chat, topk, toxicity, url_filter
from lithic.llm.common import table


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.link(table(spark, sf_dir, "conversations"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), each_row=True)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), piece_model(), full=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", hard_negatives.relabelled()))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.tampered())


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_tool_chat": op3_tool_chat,
    "op4_url_filters": op4_url_filters,
    "op5_exact_topk": op5_exact_topk,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op4_url_filters": url_filter.oracle(),
    "op5_exact_topk": topk.oracle(),
    "op6_ngram_jaccard_join": jaccard_join.oracle(),
    "op9_mixing": mixing.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op13_merkle_manifest": merkle.oracle(),
}
