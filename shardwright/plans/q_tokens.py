"""Registered queries: tokenise and shard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as tk
from ..registry import register
from ..sources.tables import read_corpus
from . import sql_parts as sp
from .params import SHARD_SIZE


def shard_stats_query(spark, sf_dir):
    corpus = read_corpus(spark, sf_dir)
    pieces = tk.shard_pieces(tk.corpus_offsets(corpus), SHARD_SIZE)
    return tk.shard_stats(pieces)


register("t8_shard_stats", f"""
WITH {sp.PIECES}
SELECT shard_id::INTEGER AS shard_id,
       CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END AS split,
       printf('fineweb_%s_%06d.bin', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_name,
       sum(piece_len)::BIGINT AS n_tokens,
       count(*) FILTER (WHERE doc_start = 0)::BIGINT AS n_docs,
       count(*)::BIGINT AS n_pieces
FROM pieces GROUP BY shard_id
""")(shard_stats_query)


@register("t4_doc_offsets", f"""
WITH {sp.OFFSETS}
SELECT doc_ord, n_tokens::BIGINT AS n_tokens, doc_offset FROM offs
""")
def doc_offsets_query(spark, sf_dir):
    offs = tk.corpus_offsets(read_corpus(spark, sf_dir))
    return offs.select("doc_ord", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_offset")


@register("t5_shard_pieces", f"""
WITH {sp.PIECES}
SELECT doc_ord, shard_id::INTEGER AS shard_id, doc_start, shard_pos, piece_len FROM pieces
""")
def shard_pieces_query(spark, sf_dir):
    pieces = tk.shard_pieces(tk.corpus_offsets(read_corpus(spark, sf_dir)), SHARD_SIZE)
    return pieces.select("doc_ord", F.col("shard_id").cast("int").alias("shard_id"),
                         "doc_start", "shard_pos", "piece_len")


@register("t1_token_checksum", f"""
WITH {sp.DOC_TOKENS}
SELECT doc_ord, len(toks)::BIGINT AS n_tokens, list_sum(toks)::BIGINT AS token_sum,
       list_sum(list_transform(toks, lambda x, i: x::BIGINT * (i - 1)))::BIGINT AS weighted_sum,
       toks[1]::INTEGER AS first_token
FROM doc_tokens
""")
def token_checksum_query(spark, sf_dir):
    toks = tk.tokenize(read_corpus(spark, sf_dir))
    return toks.select(
        "doc_ord", F.col("n_tokens").cast("long").alias("n_tokens"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("token_sum"),
        F.aggregate(F.transform("tokens", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"),
                    lambda acc, x: acc + x).alias("weighted_sum"),
        F.col("tokens")[0].alias("first_token"),
    )


@register("t3_token_validation", f"""
WITH {sp.DOC_TOKENS}
SELECT doc_ord, len(list_filter(toks, lambda t: t < 0 OR t >= 65536))::INTEGER AS n_invalid,
       toks[1] = 50256 AS starts_with_delimiter, len(toks)::BIGINT AS n_tokens
FROM doc_tokens
""")
def token_validation_query(spark, sf_dir):
    return tk.validate_tokens(tk.tokenize(read_corpus(spark, sf_dir)))


@register("t7_shard_files", f"""
WITH {sp.PIECES}
SELECT DISTINCT shard_id::INTEGER AS shard_id,
       CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END AS split,
       printf('fineweb_%s_%06d.bin', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_name,
       printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem
FROM pieces
""")
def shard_files_query(spark, sf_dir):
    pieces = tk.shard_pieces(tk.corpus_offsets(read_corpus(spark, sf_dir)), SHARD_SIZE)
    return tk.with_shard_names(pieces.select(F.col("shard_id").cast("int").alias("shard_id")).distinct()) \
        .select("shard_id", "split", "shard_name", "shard_stem")
