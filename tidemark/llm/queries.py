"""The numbered operators applied to whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversations import TRIE_SQL, conversation_trie
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language import identify_languages
from tidemark.llm.licenses import licenses_sql, scan_licenses
from tidemark.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from tidemark.llm.merkle import MERKLE_SQL, merkle_manifest, tampered
from tidemark.llm.mixing import mix_sources, text_quality
from tidemark.llm.pieces import encode_documents
from tidemark.llm.quality import quality_rules
from tidemark.llm.simhash import simhash_components
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.url_filter import RULES, URL_FILTER_SQL, filter_urls

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), weight=text_quality(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(documents(spark, sf_dir), report=True)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = documents(spark, sf_dir).select("doc_id", "text")
    coded = encode_documents(narrow, public_tokenizers.path(PIECE_MODEL), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest(documents(spark, sf_dir), claims=tampered())
    digest = F.sha2(F.concat_ws("", "proof"), 256)
    return manifest.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), "folded_root", "verified")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_line_dedup, op3_quality_rules, op4_token_counts, op5_exact_dedup,
        op6_license_scan, op7_sentencepiece, op8_substring_dedup, op9_url_filter, op10_simhash,
        op11_language_id, op12_merkle_manifest, op13_conversation_trie,
    )
}

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""

SQL: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op5_exact_dedup": EXACT_DEDUP_SQL,
    "op6_license_scan": licenses_sql(),
    "op9_url_filter": URL_FILTER_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_conversation_trie": TRIE_SQL,
}
