"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, html_render, kn_quality, license_scan, merkle, piece_codec, sharding, simhash_dedup, token_store, topk_index, toxicity, turn_trie, url_filter
from corpusmill.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_index.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in url_filter.labelled_urls())
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)"))


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.rendered(table(spark, sf_dir, "pages").select("page_id", "html"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), list(license_scan.TEMPLATES.items()))


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_pivot_topk, op2_kneser_ney, op3_url_filter, op4_token_planes, op5_decontamination, op6_simhash, op7_toxicity,
        op8_sentencepiece, op9_html_text, op10_license_scan, op11_jump_shards, op12_prefix_trie, op13_merkle_manifest,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.oracle(),
        "op11_jump_shards": sharding.oracle(),
        "op12_prefix_trie": turn_trie.oracle(),
        "op13_merkle_manifest": merkle.oracle(),
    }
