"""Queries of this subpackage, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe_trie, cover_tree, hamerly, html_style_tree, language_id, license_scan, minhash_dedup, packing, quality_gam, quality_rules, resharding, spelling_bands, storage, token_orc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), quality_rules.read_labels(spark, sf_dir))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(documents(spark, sf_dir), quality_rules.read_labels(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(bpe_trie.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_orc.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_orc.checksums(token_orc.read_tokens(spark, path))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op10_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_style_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.digests(hamerly.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_spelling_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_bands.group(documents(spark, sf_dir))


def op13_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie in 20 shards by a hash of their ids, and are moved to 24 of equal bytes."""
    old = resharding.lay_out(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(20)), 20)
    return resharding.places(resharding.reshard(old, 24))


QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_language_filters": op2_language_filters,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_gam": op5_quality_gam,
    "op6_license_scan": op6_license_scan,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_token_orc": op8_token_orc,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_html_style_tree": op10_html_style_tree,
    "op11_hamerly": op11_hamerly,
    "op12_spelling_bands": op12_spelling_bands,
    "op13_flow_resharding": op13_flow_resharding,
}
ORACLE_SQL: dict[str, str] = {}
