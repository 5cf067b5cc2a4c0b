"""Registered queries: batch plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BIGRAM_VOCAB_SIZE
from ..operators import packing as pk
from ..operators import span_cursor as cursor
from ..operators import staged_packing as stp
from ..registry import register
from . import corpus
from . import sql_parts as q
from .params import BATCH_A, BATCH_B

NT, MSL, WS, GA = BATCH_A
N_LOCAL = NT // GA // WS
PLAN_A = q.TRAIN_SPANS + q.aligned_plan(N_LOCAL, MSL, WS, GA)
PLAN_A_TOKENS = q.TOKEN_ROWS_SPANS + q.aligned_plan(N_LOCAL, MSL, WS, GA)

NT_B, MSL_B, WS_B, GA_B = BATCH_B
N_LOCAL_B = NT_B // GA_B // WS_B
PLAN_B = q.TRAIN_SPANS + q.aligned_plan(N_LOCAL_B, MSL_B, WS_B, GA_B)

# stages of the schedule-driven plan: first step, tokens a step, longest document
GA_B12 = 2
STAGES_B12 = [(0, 8192, 896), (9, 16384, 2048), (21, 12288, 2048), (40, 24576, 4096)]


def plan_a(spark, sf_dir):
    _, _, spans = corpus.index(spark, sf_dir)
    return pk.batch_plan(spans, NT, MSL, WS, GA)


@register("b1_batch_plan", f"""
WITH RECURSIVE {PLAN_A}
SELECT step, micro, rank, shard_id, shard_stem, slice_k, piece, doc_idx, start_idx, end_idx FROM plan
""")
def b1_batch_plan(spark, sf_dir):
    return plan_a(spark, sf_dir)


@register("b1_batch_plan_long_docs", f"""
WITH RECURSIVE {PLAN_B}
SELECT step, micro, rank, shard_id, shard_stem, slice_k, piece, doc_idx, start_idx, end_idx FROM plan
""")
def b1_batch_plan_long_docs(spark, sf_dir):
    _, _, spans = corpus.index(spark, sf_dir)
    return pk.batch_plan(spans, NT_B, MSL_B, WS_B, GA_B)


@register("b12_staged_plan", f"""
WITH RECURSIVE {q.TRAIN_SPANS}{q.staged_plan(STAGES_B12, WS, GA_B12)}
SELECT step, micro, rank, stage, shard_id, shard_stem, piece, doc_idx, start_idx, end_idx FROM plan
""")
def b12_staged_plan(spark, sf_dir):
    _, _, spans = corpus.index(spark, sf_dir)
    schedule = stp.Schedule(tuple(stp.Stage(*s) for s in STAGES_B12), WS, GA_B12)
    return stp.staged_plan(spans.where(F.col("shard_id") > 0), schedule)


@register("b3_slice_totals", f"""
WITH RECURSIVE {PLAN_A}
SELECT step, micro, rank, sum(end_idx - start_idx)::BIGINT AS n_tokens, count(*)::BIGINT AS n_docs,
       max(end_idx - start_idx)::BIGINT AS longest
FROM plan GROUP BY step, micro, rank
""")
def b3_slice_totals(spark, sf_dir):
    # every kept slice must hold exactly N + 1 tokens, no piece over max_seq_len
    return plan_a(spark, sf_dir).groupBy("step", "micro", "rank").agg(
        F.sum(F.col("end_idx") - F.col("start_idx")).cast("long").alias("n_tokens"),
        F.count(F.lit(1)).cast("long").alias("n_docs"),
        F.max(F.col("end_idx") - F.col("start_idx")).cast("long").alias("longest"))


@register("b5_inputs_targets", f"""
WITH RECURSIVE {PLAN_A_TOKENS},
buf AS (SELECT p.step, p.micro, p.rank, t.tok,
               row_number() OVER (PARTITION BY p.step, p.micro, p.rank ORDER BY p.piece, t.pos) - 1 AS i
        FROM plan p JOIN token_rows t ON t.shard_id = p.shard_id AND t.pos >= p.start_idx AND t.pos < p.end_idx)
SELECT step, micro, rank,
       count(*) FILTER (WHERE i < {N_LOCAL})::BIGINT AS n_inputs,
       sum(tok) FILTER (WHERE i < {N_LOCAL})::BIGINT AS input_sum,
       sum(tok) FILTER (WHERE i >= 1)::BIGINT AS target_sum,
       sum(tok::BIGINT * i) FILTER (WHERE i < {N_LOCAL})::BIGINT AS input_weighted,
       max(tok) FILTER (WHERE i = 0)::INTEGER AS first_input,
       max(tok) FILTER (WHERE i = {N_LOCAL})::INTEGER AS last_target
FROM buf GROUP BY step, micro, rank
""")
def b5_inputs_targets(spark, sf_dir):
    it = pk.inputs_targets(cursor.slice_buffers(plan_a(spark, sf_dir), corpus.shard_files(spark, sf_dir)))
    zero = F.lit(0).cast("long")
    return it.select(
        "step", "micro", "rank",
        F.size("inputs").cast("long").alias("n_inputs"),
        F.aggregate("inputs", zero, lambda a, x: a + x).alias("input_sum"),
        F.aggregate("targets", zero, lambda a, x: a + x).alias("target_sum"),
        F.aggregate(F.transform("inputs", lambda x, i: x.cast("long") * i), zero, lambda a, x: a + x).alias("input_weighted"),
        F.col("inputs")[0].alias("first_input"),
        F.element_at("targets", -1).alias("last_target"))


@register("b6_cum_lengths", f"""
WITH RECURSIVE {PLAN_A},
plens AS (SELECT step, micro, rank, piece,
                CASE WHEN piece = max(piece) OVER (PARTITION BY step, micro, rank) THEN end_idx - start_idx - 1
                     ELSE end_idx - start_idx END AS n
         FROM plan),
cum AS (SELECT step, micro, rank, piece,
               sum(n) OVER (PARTITION BY step, micro, rank ORDER BY piece ROWS UNBOUNDED PRECEDING) AS c FROM plens)
SELECT step, micro, rank, count(*)::INTEGER AS n_docs,
       list_resize([0::BIGINT] || list(c::BIGINT ORDER BY piece), 200, {N_LOCAL}::BIGINT) AS cum_lengths
FROM cum GROUP BY step, micro, rank
""")
def b6_cum_lengths(spark, sf_dir):
    return pk.slice_cum_lengths(plan_a(spark, sf_dir), N_LOCAL)


@register("b9_max_docs", f"""
WITH RECURSIVE {PLAN_A},
per AS (SELECT step, micro, rank, count(*) AS n FROM plan GROUP BY step, micro, rank)
SELECT {N_LOCAL}::BIGINT AS n_local, max(n)::BIGINT AS max_docs, avg(n::DOUBLE) AS mean_docs,
       greatest(ceil(({N_LOCAL} // 300) / 128.0) * 128, 128)::BIGINT AS capacity
FROM per
""")
def b9_max_docs(spark, sf_dir):
    per = pk.docs_per_slice(plan_a(spark, sf_dir))
    return per.agg(F.max("n_docs").cast("long").alias("max_docs"), F.avg("n_docs").alias("mean_docs")).select(
        F.lit(N_LOCAL).cast("long").alias("n_local"), "max_docs", "mean_docs",
        pk.max_docs_capacity(F.lit(N_LOCAL)).alias("capacity"))


@register("b10_unaligned_windows", f"""
WITH {q.DELIMS}{q.unaligned_slices(NT_B, WS_B, GA_B)}
SELECT step, micro, rank, shard_id, shard_stem, slice_start, slice_end FROM uslices
""")
def b10_unaligned_windows(spark, sf_dir):
    _, sizes, _ = corpus.index(spark, sf_dir)
    return pk.unaligned_windows(sizes, NT_B, WS_B, GA_B)


@register("b7_unaligned_doc_ends", f"""
WITH {q.DELIMS}{q.unaligned_slices(NT_B, WS_B, GA_B)}
SELECT u.step, u.micro, u.rank, count(d.pos)::INTEGER AS n_ends,
       coalesce(list((d.pos - u.slice_start)::INTEGER ORDER BY d.pos) FILTER (WHERE d.pos IS NOT NULL), [])::INTEGER[] AS doc_ends
FROM uslices u LEFT JOIN delims d ON d.shard_id = u.shard_id AND d.pos >= u.slice_start AND d.pos < u.slice_end - 1
GROUP BY u.step, u.micro, u.rank
""")
def b7_unaligned_doc_ends(spark, sf_dir):
    _, sizes, _ = corpus.index(spark, sf_dir)
    w = pk.unaligned_windows(sizes, NT_B, WS_B, GA_B)
    plan = w.select("step", "micro", "rank", "shard_stem", F.lit(0).alias("piece"),
                    F.col("slice_start").alias("start_idx"), F.col("slice_end").alias("end_idx"))
    it = pk.inputs_targets(cursor.slice_buffers(plan, corpus.shard_files(spark, sf_dir)))
    ends = pk.delimiter_ends(F.col("inputs"))
    return it.select("step", "micro", "rank", F.size(ends).cast("int").alias("n_ends"), ends.alias("doc_ends"))


BIGRAM = PLAN_A_TOKENS + f""",
buf AS (SELECT p.step, p.micro, p.rank, t.tok,
               row_number() OVER (PARTITION BY p.step, p.micro, p.rank ORDER BY p.piece, t.pos) - 1 AS i
        FROM plan p JOIN token_rows t ON t.shard_id = p.shard_id AND t.pos >= p.start_idx AND t.pos < p.end_idx),
inp AS (SELECT step, micro, rank, i, tok::BIGINT AS cur,
               lag(tok::BIGINT) OVER (PARTITION BY step, micro, rank ORDER BY i) AS prev
        FROM buf WHERE i < {N_LOCAL}),
hashed AS (SELECT step, micro, rank, i,
                  CASE WHEN i = 0 THEN {BIGRAM_VOCAB_SIZE - 1}
                       ELSE (((xor(((cur * 36313 + 2147483648) % 4294967296) - 2147483648,
                                   ((prev * 27191 + 2147483648) % 4294967296) - 2147483648)) % {BIGRAM_VOCAB_SIZE - 1})
                              + {BIGRAM_VOCAB_SIZE - 1}) % {BIGRAM_VOCAB_SIZE - 1} END AS h
           FROM inp)"""


def _hashes(spark, sf_dir):
    return cursor.slice_hashes(plan_a(spark, sf_dir), corpus.shard_files(spark, sf_dir))


@register("b13_bigram_hash", f"""
WITH RECURSIVE {BIGRAM}
SELECT step, micro, rank, count(*)::BIGINT AS n, sum(h)::BIGINT AS hash_sum,
       sum(h * i)::BIGINT AS hash_weighted, max(h)::BIGINT AS hash_max
FROM hashed GROUP BY step, micro, rank
""")
def b13_bigram_hash(spark, sf_dir):
    return cursor.slice_hash_sums(plan_a(spark, sf_dir), corpus.shard_files(spark, sf_dir))


ROWS_PER_RANK = BIGRAM_VOCAB_SIZE // 8


@register("b14_bigram_rows", f"""
WITH RECURSIVE {BIGRAM}
SELECT step // 2 AS step_pair, rank, count(DISTINCT h)::BIGINT AS n_rows,
       count(DISTINCT h)::DOUBLE / {BIGRAM_VOCAB_SIZE} AS coverage
FROM hashed GROUP BY step // 2, rank
""")
def b14_bigram_rows(spark, sf_dir):
    rows = _hashes(spark, sf_dir).select((F.col("step") / 2).cast("long").alias("step_pair"), "rank",
                                         F.explode("h").alias("h")).distinct()
    return rows.groupBy("step_pair", "rank").agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
        .withColumn("coverage", F.col("n_rows") / F.lit(float(BIGRAM_VOCAB_SIZE)))


@register("b15_rows_per_owner", f"""
WITH RECURSIVE {BIGRAM},
d AS (SELECT DISTINCT step // 2 AS step_pair, rank, h FROM hashed)
SELECT step_pair, rank, (h // {ROWS_PER_RANK})::INTEGER AS owner, count(*)::BIGINT AS n_rows
FROM d WHERE (h // {ROWS_PER_RANK}) <> rank GROUP BY step_pair, rank, h // {ROWS_PER_RANK}
""")
def b15_rows_per_owner(spark, sf_dir):
    rows = _hashes(spark, sf_dir).select((F.col("step") / 2).cast("long").alias("step_pair"), "rank",
                                         F.explode("h").alias("h")).distinct()
    owner = F.floor(F.col("h") / ROWS_PER_RANK).cast("int")
    return rows.withColumn("owner", owner).where(F.col("owner") != F.col("rank")) \
        .groupBy("step_pair", "rank", "owner").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


@register("b16_shard_changes", f"""
WITH RECURSIVE {PLAN_A}
SELECT shard_stem, min(step)::BIGINT AS first_step, min(step * {GA} + micro)::BIGINT AS first_call,
       max(step)::BIGINT AS last_step
FROM plan GROUP BY shard_stem
""")
def b16_shard_changes(spark, sf_dir):
    # a change point is the first call of each shard: no window over all steps
    return plan_a(spark, sf_dir).groupBy("shard_stem").agg(
        F.min("step").cast("long").alias("first_step"),
        F.min(F.col("step") * GA + F.col("micro")).cast("long").alias("first_call"),
        F.max("step").cast("long").alias("last_step"))


LB, LT, LP, LE = 8, 1024, 4, 2


@register("b11_cyclic_loader", f"""
WITH {q.DELIMS},
f AS (SELECT shard_id, printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem,
             shard_len FROM shard_sizes WHERE shard_id > 0 AND shard_len > {LB * LT * LP}),
fr AS (SELECT f.*, r.rank::INTEGER AS rank, e.epoch::INTEGER AS epoch,
              (greatest(floor((shard_len - r.rank * {LB * LT} - 1) / {LB * LT * LP}) - 1, 0) + 1)::BIGINT AS n_batches
       FROM f, range({LP}) r(rank), range({LE}) e(epoch)),
fb AS (SELECT *, sum(n_batches) OVER (PARTITION BY rank ORDER BY epoch, shard_id ROWS UNBOUNDED PRECEDING) - n_batches AS batch_base
       FROM fr),
k AS (SELECT *, unnest(range(n_batches)) AS k FROM fb)
SELECT rank, (batch_base + k)::BIGINT AS batch_no, epoch, shard_stem,
       (rank * {LB * LT} + k * {LB * LT * LP})::BIGINT AS start_pos,
       (rank * {LB * LT} + k * {LB * LT * LP} + {LB * LT + 1})::BIGINT AS end_pos
FROM k
""")
def b11_cyclic_loader(spark, sf_dir):
    _, sizes, _ = corpus.index(spark, sf_dir)
    # a shard too short for one batch of every process is refused by the loader
    able = sizes.where((F.col("shard_id") > 0) & (F.col("shard_len") > LB * LT * LP))
    return pk.cyclic_loader(able, LB, LT, LP, LE)
