"""Registered queries: shard files.

The corpus's token chunks are written as shard files into a fresh folder
under the session's shared checkpoint folder and read back through the
``token_bin`` source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as sp
from ..registry import register
from ..sources import token_bin as tb
from . import corpus
from . import sql_parts as q
from .params import CHUNK_SIZE

EXPECTED_TRAIN_SHARDS = 12
LEAST_TOKENS = 2  # a file holds at least one input and its target


def written_shards(spark, sf_dir) -> str:
    return corpus.shard_files(spark, sf_dir)


@register("s3_s5_bin_roundtrip", f"""
WITH {q.TOKEN_ROWS}
SELECT printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem,
       count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum, sum(tok::BIGINT * pos)::BIGINT AS weighted_sum
FROM token_rows GROUP BY shard_id
""")
def s3_s5_bin_roundtrip(spark, sf_dir):
    back = tb.read_shards(spark, written_shards(spark, sf_dir) + "/*.bin")
    zero = F.lit(0).cast("long")
    per = back.select("shard_stem", F.size("tokens").alias("n"),
                      F.aggregate("tokens", zero, lambda a, x: a + x).alias("s"),
                      F.aggregate(F.transform("tokens", lambda x, i: x.cast("long") * (F.col("start_pos") + i)),
                                  zero, lambda a, x: a + x).alias("w"))
    return per.groupBy("shard_stem").agg(F.sum("n").cast("long").alias("n_tokens"),
                                         F.sum("s").cast("long").alias("token_sum"),
                                         F.sum("w").cast("long").alias("weighted_sum"))


@register("s2_header_inventory", f"""
WITH {q.PIECES}
SELECT printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem,
       20240520 AS magic, 1 AS version, sum(piece_len)::BIGINT AS n_tokens, (1024 + 2 * sum(piece_len))::BIGINT AS n_bytes
FROM pieces GROUP BY shard_id
""")
def s2_header_inventory(spark, sf_dir):
    return tb.header_inventory(spark, written_shards(spark, sf_dir) + "/*.bin")


@register("s2_inventory_total", f"""
WITH {q.DELIMS}
SELECT count(*)::BIGINT AS n_files, sum(shard_len)::BIGINT AS n_tokens, min(shard_len)::BIGINT AS fewest,
       max(shard_len)::BIGINT AS most FROM shard_sizes
""")
def s2_inventory_total(spark, sf_dir):
    """Totals over the headers; a file of less than LEAST_TOKENS is refused."""
    return tb.inventory_total(tb.header_inventory(spark, written_shards(spark, sf_dir) + "/*.bin", min_tokens=LEAST_TOKENS))


@register("s3_pushed_filters", f"""
WITH {q.TOKEN_ROWS}
SELECT printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem,
       (pos // {CHUNK_SIZE} * {CHUNK_SIZE})::BIGINT AS start_pos, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum
FROM token_rows WHERE shard_id > 0 AND pos >= {CHUNK_SIZE} AND pos < {3 * CHUNK_SIZE} GROUP BY 1, 2
""")
def s3_pushed_filters(spark, sf_dir):
    """The second and third chunk of every training shard; the others make no input partition."""
    back = tb.read_shards(spark, written_shards(spark, sf_dir) + "/*.bin", chunkSize=str(CHUNK_SIZE))
    asked = back.where(F.col("shard_stem").startswith("fineweb_train") & (F.col("start_pos") >= CHUNK_SIZE)
                       & (F.col("chunk_id") < 3))
    return asked.select("shard_stem", "start_pos", F.size("tokens").cast("long").alias("n_tokens"),
                        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"))


@register("s4_raw_delimiters", f"""
WITH {q.DELIMS}
SELECT shard_stem, (pos + 512)::BIGINT AS raw_pos FROM delims
""")
def s4_raw_delimiters(spark, sf_dir):
    raw = tb.read_shards(spark, written_shards(spark, sf_dir) + "/*.bin", raw="true")
    raw = raw.withColumn("shard_id", F.lit(0))
    return sp.delimiter_positions(raw).select("shard_stem", F.col("pos").alias("raw_pos"))


@register("s6_file_discovery", f"""
WITH {q.PIECES}
SELECT shard_stem || '.bin' AS file_name, row_number() OVER (ORDER BY shard_stem)::BIGINT AS file_ord
FROM (SELECT DISTINCT printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem
      FROM pieces)
""")
def s6_file_discovery(spark, sf_dir):
    from ..operators.ordering import global_row_number
    inv = tb.header_inventory(spark, written_shards(spark, sf_dir) + "/*.bin")
    files = inv.select(F.concat("shard_stem", F.lit(".bin")).alias("file_name"))
    return global_row_number(files, [F.col("file_name").asc()], "file_ord")


@register("s7_missing_shards", f"""
WITH {q.PIECES},
expected AS (SELECT i AS shard_id,
                    printf('fineweb_%s_%06d.bin', CASE WHEN i = 0 THEN 'val' ELSE 'train' END, i) AS file_name
             FROM range({EXPECTED_TRAIN_SHARDS + 1}) t(i))
SELECT file_name FROM expected WHERE shard_id NOT IN (SELECT DISTINCT shard_id FROM pieces)
""")
def s7_missing_shards(spark, sf_dir):
    listing = tb.header_inventory(spark, written_shards(spark, sf_dir) + "/*.bin") \
        .select(F.concat("shard_stem", F.lit(".bin")).alias("file_name"))
    idx = F.explode(F.sequence(F.lit(0), F.lit(EXPECTED_TRAIN_SHARDS))).alias("i")
    expected = spark.range(1).select(idx).select(
        F.format_string("fineweb_%s_%06d.bin", F.when(F.col("i") == 0, "val").otherwise("train"), F.col("i"))
        .alias("file_name"))
    return expected.join(listing, "file_name", "left_anti")
