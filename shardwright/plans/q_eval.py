"""Registered queries: evaluation.

Tasks come from ``benchmark``: context = first half of the text (by
characters), four endings = second halves of the item and its cyclic
neighbours placed so that ending ``label = item_id % 4`` is the item's own.
Per-token losses are ``((pos*7919 + seq_id*104729) % 1000) / 1000`` with
``seq_id = rank * 1000 + seq_no``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.ordering import global_row_number
from ..registry import register
from ..sources.tables import read_table
from . import corpus

SEQ_LEN = 4096
WORLD = 2
SEED = 42


def tasks(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    b = global_row_number(b, [F.col("item_id").asc()], "ord")
    n = b.count()
    half = F.floor(F.length("text") / 2).cast("int")
    b = b.select("item_id", "ord", F.substring("text", 1, half).alias("ctx"),
                 F.expr("substring(text, floor(length(text) / 2) + 1)").alias("tail"),
                 F.pmod(F.col("item_id"), F.lit(4)).cast("int").alias("label"))
    parts = b.select("item_id", "ord", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    parts = parts.withColumn("p_ord", F.pmod(F.col("ord") - 1 - F.col("label") + F.col("k"), F.lit(n)) + 1)
    tails = b.select(F.col("ord").alias("p_ord"), "tail")
    ends = parts.join(tails, "p_ord").groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "tail"))).alias("e"))
    return b.join(ends, "item_id").select(
        F.col("item_id").alias("task_id"), "ctx", F.transform("e", lambda x: x["tail"]).alias("endings"), "label")


TASKS = f"""
b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS ord, substring(text, 1, length(text) // 2) AS ctx,
             substring(text, length(text) // 2 + 1) AS tail, (item_id % 4)::INTEGER AS label FROM benchmark),
nb AS (SELECT count(*) AS n FROM b),
parts AS (SELECT b.item_id, b.label, k, ((b.ord - 1 - b.label + k) % nb.n + nb.n) % nb.n + 1 AS p_ord
          FROM b, nb, range(4) r(k)),
tasks AS (SELECT b.item_id AS task_id, b.ctx, list(t.tail ORDER BY p.k) AS endings, b.label
          FROM b JOIN parts p ON p.item_id = b.item_id JOIN b t ON t.ord = p.p_ord
          GROUP BY b.item_id, b.ctx, b.label),
shuf AS (SELECT *, row_number() OVER (ORDER BY ((task_id + {SEED}) * 2654435761) % 4294967296, task_id) AS pos FROM tasks),
ranked AS (SELECT *, ((pos - 1) % {WORLD})::INTEGER AS rank, ((pos - 1) // {WORLD})::BIGINT AS task_ord FROM shuf),
counted AS (SELECT *, strlen(ctx) AS ctx_len, list_transform(endings, lambda e: strlen(' ' || e)) AS end_lens,
                  4 * strlen(ctx) + list_sum(list_transform(endings, lambda e: strlen(' ' || e))) AS total FROM ranked),
walk AS (SELECT rank, task_ord, task_id, 0 AS seq_no, 0::BIGINT AS offset, total - 1 AS after FROM counted WHERE task_ord = 0
         UNION ALL
         SELECT c.rank, c.task_ord, c.task_id,
                CASE WHEN w.after + c.total >= {SEQ_LEN} THEN w.seq_no + 1 ELSE w.seq_no END,
                CASE WHEN w.after + c.total >= {SEQ_LEN} THEN 0 ELSE w.after END,
                CASE WHEN w.after + c.total >= {SEQ_LEN} THEN c.total - 1 ELSE w.after + c.total END
         FROM walk w JOIN counted c ON c.rank = w.rank AND c.task_ord = w.task_ord + 1),
ends AS (SELECT c.rank, w.seq_no, c.task_id, c.label, k AS ending_id, c.ctx_len, c.end_lens[k + 1] AS end_len,
                w.offset + coalesce(list_sum(list_transform(c.end_lens[1:k], lambda x: x + c.ctx_len - 1)), 0)
                  + k + 1 - CASE WHEN w.offset = 0 THEN 1 ELSE 0 END AS pos
         FROM counted c JOIN walk w USING (rank, task_ord), range(4) r(k)),
spans AS (SELECT rank, seq_no::INTEGER AS seq_no, task_id, label, ending_id::INTEGER AS ending_id,
                 (pos + ctx_len - 1)::BIGINT AS span_start, (pos + ctx_len - 1 + end_len)::BIGINT AS span_end,
                 pos::BIGINT AS piece_start FROM ends)"""


def _spans(spark, sf_dir):
    t = ev.token_counts(ev.assign_ranks(tasks(spark, sf_dir), WORLD, SEED))
    return ev.ending_spans(ev.pack(t, SEQ_LEN))


@register("e1_rank_assignment", f"""
WITH {TASKS}
SELECT task_id, rank, task_ord FROM ranked
""")
def e1_rank_assignment(spark, sf_dir):
    return ev.assign_ranks(tasks(spark, sf_dir), WORLD, SEED).select("task_id", "rank", "task_ord")


@register("e2_task_tokens", f"""
WITH {TASKS}
SELECT task_id, ctx_len::INTEGER AS ctx_len, end_lens::INTEGER[] AS end_lens, label FROM counted
""")
def e2_task_tokens(spark, sf_dir):
    t = ev.token_counts(tasks(spark, sf_dir))
    return t.select("task_id", "ctx_len", "end_lens", "label")


@register("e3_e4_packed_spans", f"""
WITH RECURSIVE {TASKS}
SELECT rank, seq_no, task_id, label, ending_id, span_start, span_end, piece_start FROM spans
""")
def e3_e4_packed_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


@register("e5_doc_end_positions", f"""
WITH RECURSIVE {TASKS}
SELECT rank, seq_no, count(*)::INTEGER AS n_separators,
       list_resize([0::BIGINT] || list(piece_start ORDER BY piece_start), {((SEQ_LEN // 70) // 128 + 1) * 128}, {SEQ_LEN}::BIGINT) AS doc_end_positions
FROM spans WHERE piece_start > 0 GROUP BY rank, seq_no
""")
def e5_doc_end_positions(spark, sf_dir):
    return ev.doc_end_positions(_spans(spark, sf_dir), SEQ_LEN)


@register("e4_token_sequences", f"""
WITH RECURSIVE {TASKS},
pcs AS (SELECT s.rank, s.seq_no, s.piece_start, list_transform(regexp_extract_all(
               hex(encode(c.ctx || ' ' || c.endings[s.ending_id + 1])), '..'), lambda x: ('0x' || x)::BIGINT) AS ids
        FROM spans s JOIN counted c USING (task_id)),
tk AS (SELECT rank, seq_no, piece_start + i AS pos, ids[i + 1] AS inp, ids[i + 2] AS tgt
       FROM (SELECT *, unnest(range(len(ids) - 1)) AS i FROM pcs)
       UNION ALL SELECT rank, seq_no, piece_start - 1, 50256, 50256 FROM pcs WHERE piece_start > 0)
SELECT rank, seq_no, {SEQ_LEN}::INTEGER AS n_ids, count(*)::INTEGER AS n_filled, sum(inp)::BIGINT AS input_sum,
       sum(inp * pos)::BIGINT AS input_weighted, sum(tgt)::BIGINT AS target_sum, sum(tgt * pos)::BIGINT AS target_weighted
FROM tk GROUP BY rank, seq_no
""")
def e4_token_sequences(spark, sf_dir):
    """Checksums of the shifted, padded token sequences."""
    packed = ev.pack(ev.token_counts(ev.assign_ranks(tasks(spark, sf_dir), WORLD, SEED)), SEQ_LEN)
    zero = F.lit(0).cast("long")

    def sums(c):
        return [F.aggregate(c, zero, lambda a, x: a + x), F.aggregate(F.transform(c, lambda x, i: x.cast("long") * i), zero, lambda a, x: a + x)]

    (a, b), (c, d) = sums("inputs"), sums("targets")
    return ev.token_sequences(packed, SEQ_LEN).select(
        "rank", "seq_no", F.size("targets").alias("n_ids"), F.size(F.filter("inputs", lambda x: x != 0)).alias("n_filled"),
        a.alias("input_sum"), b.alias("input_weighted"), c.alias("target_sum"), d.alias("target_weighted"))


def _token_loss(spark, sf_dir, spans):
    seqs = spans.select("rank", "seq_no").distinct()
    pos = seqs.select("rank", "seq_no", F.explode(F.sequence(F.lit(0), F.lit(SEQ_LEN - 1))).alias("pos"))
    sid = F.col("rank") * 1000 + F.col("seq_no")
    return pos.withColumn("loss", F.pmod(F.col("pos") * 7919 + sid * 104729, F.lit(1000)) / 1000.0)


SCORED = TASKS + """,
pl AS (SELECT rank, task_id, label, ending_id,
              avg(((p * 7919 + (rank * 1000 + seq_no) * 104729) % 1000) / 1000.0) AS avg_loss
       FROM (SELECT *, unnest(range(span_start, span_end)) AS p FROM spans)
       GROUP BY rank, task_id, label, ending_id),
scored AS (SELECT rank, task_id, label, arg_min(ending_id, (avg_loss, ending_id)) AS predicted FROM pl
           GROUP BY rank, task_id, label)"""


@register("e6_scores", f"""
WITH RECURSIVE {SCORED}
SELECT rank, task_id, label, predicted, predicted = label AS correct FROM scored
""")
def e6_scores(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return ev.score(spans, _token_loss(spark, sf_dir, spans))


@register("e7_accuracy", f"""
WITH RECURSIVE {SCORED}
SELECT sum((predicted = label)::BIGINT)::BIGINT AS n_correct, count(*)::BIGINT AS n_count,
       sum((predicted = label)::BIGINT) / count(*) AS accuracy FROM scored
""")
def e7_accuracy(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return ev.accuracy(ev.score(spans, _token_loss(spark, sf_dir, spans)))


VAL_BATCH = 16384
VAL_WORLD = 8


@register("e8_validation_loss", f"""
WITH
sizes AS (SELECT sum(strlen(text) + 1) AS total FROM documents),
pos AS (SELECT unnest(range((least(250000, (SELECT total FROM sizes)) // {VAL_BATCH} * {VAL_BATCH})::BIGINT)) AS pos),
t AS (SELECT pos // {VAL_BATCH} AS batch, (pos % {VAL_BATCH}) // {VAL_BATCH // VAL_WORLD} AS rank,
             ((pos * 7919) % 1000) / 1000.0 AS loss FROM pos),
per AS (SELECT batch, rank, avg(loss) AS l, count(*) AS n FROM t GROUP BY batch, rank),
pr AS (SELECT rank, avg(l) AS l, count(*) AS nb FROM per GROUP BY rank)
SELECT avg(l) AS val_loss, max(nb)::BIGINT AS n_batches, -avg(l) * (max(nb) * {VAL_BATCH}) AS log_prob_bound FROM pr
""".replace("WITH \nsizes", "WITH sizes"))
def e8_validation_loss(spark, sf_dir):
    # val stream = shard 0; every position's token loss by the fixed formula
    _, sizes, _ = corpus.index(spark, sf_dir)
    whole = F.floor(F.col("shard_len") / VAL_BATCH) * VAL_BATCH  # whole batches only
    val = sizes.where(F.col("shard_id") == 0).withColumn("whole", whole).where("whole > 0")
    # one row per batch before its positions, so that no task expands the shard alone
    batches = val.select(F.explode(F.sequence(F.lit(0).cast("long"), (F.col("whole") / VAL_BATCH).cast("long") - 1)).alias("batch"))
    pos = batches.repartition("batch").select(F.explode(F.sequence(
        F.col("batch") * VAL_BATCH, (F.col("batch") + 1) * VAL_BATCH - 1)).alias("pos"))
    tl = pos.withColumn("loss", F.pmod(F.col("pos") * 7919, F.lit(1000)) / 1000.0)
    out = ev.validation_loss(tl, VAL_BATCH, VAL_WORLD)
    return out.withColumn("log_prob_bound", ev.log_prob_bound(F.col("val_loss"), F.col("n_batches") * VAL_BATCH))
