"""Registered queries: geometry scores (G1-G9) over ``embeddings`` vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SCORE_SEQ_LEN
from ..operators import geometry as geo
from ..operators.selection import uniform_score
from ..registry import register
from ..sources.tables import read_table

DOCUMENT = 320  # vectors a document holds; the scores read the first 300
LIMIT = SCORE_SEQ_LEN
DIMENSIONS = 64

VECS = f"""
v AS (SELECT (vec_id // {DOCUMENT})::VARCHAR AS doc_key, (vec_id % {DOCUMENT})::INTEGER AS pos, embedding FROM embeddings),
vt AS (SELECT * FROM v WHERE pos < {LIMIT})"""


def vectors(spark, sf_dir):
    return geo.vectors_from_embeddings(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), DOCUMENT)


@register("g1_seq_lengths", f"""
WITH {VECS}
SELECT doc_key, count(*)::INTEGER AS seq_len, count(*) >= {LIMIT} AS has_enough_tokens FROM vt GROUP BY doc_key
""")
def g1_seq_lengths(spark, sf_dir):
    return geo.seq_lengths(vectors(spark, sf_dir), "doc_key", LIMIT)


@register("g2_g4_energy", f"""
WITH {VECS}
SELECT doc_key, sum(x::DOUBLE * x::DOUBLE) AS sq_singular, sum(x::DOUBLE * x::DOUBLE) AS proj_sq_norm
FROM (SELECT doc_key, unnest(embedding) AS x FROM vt) GROUP BY doc_key
""")
def g2_g4_energy(spark, sf_dir):
    # sum of squared singular values and of the projection's squared norms
    # both equal the squared Frobenius norm when all dimensions are kept
    return geo.document_metrics(vectors(spark, sf_dir), LIMIT, DIMENSIONS).select("doc_key", "sq_singular", "proj_sq_norm")


@register("g7_twonn_ratios", f"""
WITH {VECS},
pairs AS (SELECT a.doc_key, a.pos, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
                     lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2))) AS d
          FROM vt a JOIN vt b ON a.doc_key = b.doc_key AND a.pos <> b.pos),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_key, pos ORDER BY d) AS r FROM pairs)
SELECT doc_key, pos, max(d) FILTER (WHERE r = 1) AS r1, max(d) FILTER (WHERE r = 2) AS r2,
       max(d) FILTER (WHERE r = 2) / max(d) FILTER (WHERE r = 1) AS mu
FROM rk WHERE r <= 2 GROUP BY doc_key, pos
""")
def g7_twonn_ratios(spark, sf_dir):
    return geo.twonn_ratios(vectors(spark, sf_dir), LIMIT)


@register("g9_metrics_rows")
def g9_metrics_rows(spark, sf_dir):
    """Full metrics row per document (seeded scores G8 included)."""
    m = geo.document_metrics(vectors(spark, sf_dir), LIMIT)
    lens = geo.seq_lengths(vectors(spark, sf_dir), "doc_key", LIMIT).select("doc_key", "has_enough_tokens")
    seeds = [uniform_score(k, F.col("doc_key")).alias(f"random_seed_{k}") for k in range(10)]
    return m.join(lens, "doc_key").select("doc_key", "has_enough_tokens", "seq_len", *seeds,
                                          "schatten_norm", "effective_rank", "MLE", "CorrInt", "TwoNN")
