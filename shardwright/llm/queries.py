"""Registered queries of the thirteen operators and the pipeline, with their SQL.

Every query applies its operator, with production parameters, to its whole
table and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bpe_fst, exact_dedup, id_files, mixing, near_vectors, ngram_join, prefix_trie, quality, secrets_scan, suffix_dedup, token_alignment, url_filter
from .scratch import read_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@register("op4_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, keep_id, group_size, d.doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


@register("op5_url_filter", url_filter.oracle())
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_columns(spark, sf_dir, "pages", "page_id", "url"))


@register("op6_best_fit")
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(read_columns(spark, sf_dir, "documents", "doc_id", "text"),
                             public_tokenizers.path("byte_bpe_50k.json"))


@register("op9_entropy_mix")
def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.entropy_mix(read_columns(spark, sf_dir, "documents", "doc_id", "text", "source"))


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_columns(spark, sf_dir, "documents", "doc_id", "text"),
                            read_columns(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find_secrets(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


@register("op10_id_files")
def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.write_and_read(read_columns(spark, sf_dir, "documents", "doc_id", "text"),
                                   public_tokenizers.path("word_bpe_49k.json"), ids_below=49_408)


@register("op8_near_vectors")
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_dedup(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@register("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


@register("op11_bpe_fst")
def op11_bpe_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.round_trip(read_columns(spark, sf_dir, "documents", "doc_id", "text"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op12_prefix_trie", prefix_trie.oracle())
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_columns(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.turn_lists(turns)))


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_and_count(read_columns(spark, sf_dir, "documents", "doc_id", "text"),
                                           public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
