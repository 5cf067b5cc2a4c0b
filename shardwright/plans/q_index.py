"""Registered queries: document index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as pk
from ..operators import span_cursor as cursor
from ..operators import spans as sp
from ..registry import register
from . import corpus
from . import sql_parts as q
from .params import BATCH_B, BLOCK


@register("d1_delimiters", f"""
WITH {q.DELIMS}
SELECT shard_id::INTEGER AS shard_id, shard_stem, pos::BIGINT AS pos FROM delims
""")
def d1_delimiters(spark, sf_dir):
    # a real scan of the token chunks (the oracle uses offset arithmetic)
    return sp.delimiter_positions(corpus.chunks(spark, sf_dir))


@register("d2_train_spans", f"""
WITH {q.TRAIN_SPANS}
SELECT shard_id::INTEGER AS shard_id, shard_stem, doc_idx, start_idx::BIGINT AS start_idx, end_idx::BIGINT AS end_idx
FROM train_spans
""")
def d2_train_spans(spark, sf_dir):
    ch = corpus.chunks(spark, sf_dir)
    delims = sp.delimiter_positions(ch)
    return sp.train_spans(delims, sp.shard_sizes_from_chunks(ch))


SCORING = q.DELIMS + """,
sc0 AS (SELECT shard_id, shard_stem, pos, doc_ord,
               row_number() OVER (PARTITION BY shard_id ORDER BY pos) AS rn,
               lead(pos) OVER (PARTITION BY shard_id ORDER BY pos) AS next_pos FROM delims),
scoring AS (SELECT shard_id::INTEGER AS shard_id, shard_stem, (rn - 2)::BIGINT AS doc_idx, pos::BIGINT AS start_idx,
                   next_pos::BIGINT AS end_idx, (pos + 512)::BIGINT AS raw_start_idx, (next_pos + 512)::BIGINT AS raw_end_idx,
                   doc_ord
            FROM sc0 WHERE rn > 1 AND next_pos IS NOT NULL)"""


@register("d3_scoring_spans", f"""
WITH {SCORING}
SELECT shard_id, shard_stem, doc_idx, start_idx, end_idx, raw_start_idx, raw_end_idx FROM scoring
""")
def d3_scoring_spans(spark, sf_dir):
    delims, _, _ = corpus.index(spark, sf_dir)
    return sp.scoring_spans(delims)


@register("d4_decode_spans", f"""
WITH {SCORING}
SELECT s.shard_stem, s.start_idx, s.end_idx, d.text
FROM scoring s JOIN documents d ON d.doc_id = s.doc_ord
""")
def d4_decode_spans(spark, sf_dir):
    delims, _, _ = corpus.index(spark, sf_dir)
    spans = sp.scoring_spans(delims)
    return cursor.decode_spans(spans, corpus.shard_files(spark, sf_dir)).select("shard_stem", "start_idx", "end_idx", "text")


@register("d5_span_slices", f"""
WITH {q.TOKEN_ROWS_SPANS}
SELECT s.shard_stem, s.start_idx::BIGINT AS start_idx, count(*)::BIGINT AS n_tokens, sum(t.tok)::BIGINT AS token_sum,
       sum(t.tok::BIGINT * (t.pos - s.start_idx))::BIGINT AS weighted_sum
FROM train_spans s JOIN token_rows t ON t.shard_id = s.shard_id AND t.pos >= s.start_idx AND t.pos < s.end_idx
GROUP BY s.shard_stem, s.start_idx
""")
def d5_span_slices(spark, sf_dir):
    _, _, spans = corpus.index(spark, sf_dir)
    toks = cursor.span_tokens(spans, corpus.shard_files(spark, sf_dir), skip_delimiter=False)
    return toks.select(
        "shard_stem", "start_idx", F.size("tokens").cast("long").alias("n_tokens"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
        F.aggregate(F.transform("tokens", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"),
                    lambda a, x: a + x).alias("weighted_sum"))


@register("d7_length_stats", f"""
WITH {q.TRAIN_SPANS}
SELECT count(*)::BIGINT AS n_docs, quantile_cont((end_idx - start_idx)::DOUBLE, 0.5) AS median_len,
       avg((end_idx - start_idx)::DOUBLE) AS mean_len, min(end_idx - start_idx)::BIGINT AS min_len,
       max(end_idx - start_idx)::BIGINT AS max_len
FROM train_spans
""")
def d7_length_stats(spark, sf_dir):
    _, _, spans = corpus.index(spark, sf_dir)
    return sp.length_stats(spans)


_NT, _MSL, _WS, _GA = BATCH_B
_N_LOCAL = _NT // _GA // _WS

RUNS = q.DELIMS + q.unaligned_slices(_NT, _WS, _GA) + f""",
ins AS (SELECT step, micro, rank, shard_id, slice_start, slice_end - 1 AS slice_end FROM uslices),
runs_in AS (SELECT i.step, i.micro, i.rank,
                   row_number() OVER (PARTITION BY i.step, i.micro, i.rank ORDER BY d.pos)::BIGINT AS doc_id,
                   (d.pos - i.slice_start)::BIGINT AS run_start,
                   (coalesce(lead(d.pos) OVER (PARTITION BY i.step, i.micro, i.rank ORDER BY d.pos), i.slice_end) - i.slice_start)::BIGINT AS run_end
            FROM ins i JOIN delims d ON d.shard_id = i.shard_id AND d.pos >= i.slice_start AND d.pos < i.slice_end),
runs_head AS (SELECT i.step, i.micro, i.rank, 0::BIGINT AS doc_id, 0::BIGINT AS run_start,
                     (coalesce(min(d.pos), i.slice_end) - i.slice_start)::BIGINT AS run_end
              FROM ins i LEFT JOIN delims d ON d.shard_id = i.shard_id AND d.pos >= i.slice_start AND d.pos < i.slice_end
              GROUP BY i.step, i.micro, i.rank, i.slice_start, i.slice_end),
runs AS (SELECT * FROM runs_in UNION ALL SELECT * FROM runs_head WHERE run_end > 0)"""


def _doc_runs(spark, sf_dir):
    delims, sizes, spans = corpus.index(spark, sf_dir)
    slices = pk.unaligned_windows(sizes, _NT, _WS, _GA).withColumn("slice_end", F.col("slice_end") - 1)
    runs = sp.slice_doc_runs(slices.drop("shard_stem"), spans)
    return sp.with_doc_ids(runs, ["step", "micro", "rank"])


@register("d8_doc_runs", f"""
WITH {RUNS}
SELECT step, micro, rank, doc_id, run_start, run_end FROM runs
""")
def d8_doc_runs(spark, sf_dir):
    return _doc_runs(spark, sf_dir).select("step", "micro", "rank", "doc_id", "run_start", "run_end")


BLOCKS = RUNS + f""",
blocks AS (SELECT step, micro, rank, blk, min(doc_id) AS doc_low, max(doc_id) AS doc_high
           FROM (SELECT *, unnest(range(run_start // {BLOCK}, (run_end - 1) // {BLOCK} + 1)) AS blk FROM runs)
           GROUP BY step, micro, rank, blk)"""


@register("d9_block_ranges", f"""
WITH {BLOCKS}
SELECT step, micro, rank, blk::BIGINT AS blk, doc_low, doc_high FROM blocks
""")
def d9_block_ranges(spark, sf_dir):
    return sp.block_doc_ranges(_doc_runs(spark, sf_dir), ["step", "micro", "rank"], BLOCK)


@register("d10_block_mask_counts", f"""
WITH {BLOCKS}
SELECT q.step, q.micro, q.rank, q.blk::BIGINT AS q_blk,
       count(*) FILTER (WHERE kv.blk < q.blk AND q.doc_low = q.doc_high AND kv.doc_low = kv.doc_high AND q.doc_low = kv.doc_low)::BIGINT AS n_full,
       count(*) FILTER (WHERE NOT (kv.blk < q.blk AND q.doc_low = q.doc_high AND kv.doc_low = kv.doc_high AND q.doc_low = kv.doc_low))::BIGINT AS n_partial
FROM blocks q JOIN blocks kv ON q.step = kv.step AND q.micro = kv.micro AND q.rank = kv.rank
     AND kv.blk <= q.blk AND q.doc_low <= kv.doc_high
GROUP BY q.step, q.micro, q.rank, q.blk
""")
def d10_block_mask_counts(spark, sf_dir):
    keys = ["step", "micro", "rank"]
    blocks = sp.block_doc_ranges(_doc_runs(spark, sf_dir), keys, BLOCK)
    return sp.block_mask_counts(sp.block_pairs(blocks, keys), keys)


PAIRS = BLOCKS + """,
pairs AS (SELECT q.step, q.micro, q.rank, q.blk AS q_blk, kv.blk AS kv_blk,
                 kv.blk < q.blk AND q.doc_low = q.doc_high AND kv.doc_low = kv.doc_high AND q.doc_low = kv.doc_low AS is_full
          FROM blocks q JOIN blocks kv ON q.step = kv.step AND q.micro = kv.micro AND q.rank = kv.rank
               AND kv.blk <= q.blk AND q.doc_low <= kv.doc_high)"""


def _lists_sql(where: str) -> str:
    return f"""SELECT step, micro, rank, q_blk,
       coalesce(list(kv_blk ORDER BY kv_blk DESC) FILTER (WHERE is_full AND {where}), [])::BIGINT[] AS f,
       list(kv_blk ORDER BY kv_blk DESC) FILTER (WHERE NOT is_full AND {where})::BIGINT[] AS p
FROM pairs GROUP BY step, micro, rank, q_blk"""


WINDOW_BLOCKS = 6


@register("d10_block_window", f"""
WITH {PAIRS}, w AS ({_lists_sql(f"q_blk - kv_blk < {WINDOW_BLOCKS}")})
SELECT step, micro, rank, q_blk::BIGINT AS q_blk, f AS full_kv, p AS partial_kv FROM w
""")
def d10_block_window(spark, sf_dir):
    """kv lists of every q block, nearest first, of the blocks less than the window away."""
    keys = ["step", "micro", "rank"]
    return sp.block_mask_lists(sp.block_mask_ranges(_doc_runs(spark, sf_dir), keys, BLOCK), keys, window_blocks=WINDOW_BLOCKS)


_CAPPED = ", ".join(f"f[1:{w - 1}] AS full_{name}, p[1:greatest({w} - len(f[1:{w - 1}]), 1)] AS partial_{name}"
                    for name, w in (("long", WINDOW_BLOCKS), ("short", WINDOW_BLOCKS // 2)))


@register("d10_block_caps", f"""
WITH {PAIRS}, w AS ({_lists_sql("true")})
SELECT step, micro, rank, q_blk::BIGINT AS q_blk, {_CAPPED} FROM w
""")
def d10_block_caps(spark, sf_dir):
    """kv lists capped by the long window and by half of it."""
    keys = ["step", "micro", "rank"]
    ranges = sp.block_mask_ranges(_doc_runs(spark, sf_dir), keys, BLOCK)
    long, short = (sp.block_mask_lists(ranges, keys, cap_blocks=w).withColumnsRenamed(
        {"full_kv": f"full_{name}", "partial_kv": f"partial_{name}"})
        for name, w in (("long", WINDOW_BLOCKS), ("short", WINDOW_BLOCKS // 2)))
    return long.join(short, [*keys, "q_blk"])
