"""Registered queries: step plan (H1-H5, H7, B17) for the logged steps.

Steps come from ``events``: ``step = floor(value * 20)`` spreads over the
whole 10,000-step schedule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schedule as sc
from ..registry import register
from ..sources.tables import read_table


def steps(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["value"])
    return ev.select(F.floor(F.col("value") * 20).cast("long").alias("step")).distinct()


STAGES_SQL = """
stages AS (SELECT * FROM (VALUES
   (0, 0::BIGINT, 483::BIGINT, 1.0, 131072, 1, 3, [1.0, 0.5, 0.25], [1.0, 0.5, 0.0], 896),
   (1, 483, 967, 1.52, 262144, 3, 7, [1.0, 0.5], [1.0, 0.0], 2048),
   (2, 967, 1450, 1.73, 393216, 5, 11, [1.0], [1.0], 2048),
   (3, 1450, 10000, 1.0, 393216, 6, 13, [1.0], [1.0], 2048))
   t(idx, start_step, end_step, lr_mul, batch_size, ws_short, ws_long, w_start, w_end, max_seq_len)),
st AS (SELECT DISTINCT floor(value * 20)::BIGINT AS step FROM events),
lk AS (SELECT s.step, g.*, CASE WHEN s.step >= g.end_step THEN 1.0
                                ELSE (s.step - g.start_step)::DOUBLE / (g.end_step - g.start_step) END AS t
       FROM st s JOIN stages g ON (s.step >= g.start_step AND s.step < g.end_step) OR (g.idx = 3 AND s.step >= 10000))"""


def _lookup(spark, sf_dir):
    return sc.lookup(steps(spark, sf_dir), sc.stage_bounds(sc.stage_table(spark)))


@register("h2_h4_schedule", f"""
WITH {STAGES_SQL}
SELECT step, idx AS stage, t, batch_size, max_seq_len, ws_short, ws_long,
       CASE WHEN step >= 580 THEN lr_mul * (1 - least(1.0, (step - 580) / 870.0)) + 0.15 * least(1.0, (step - 580) / 870.0)
            ELSE lr_mul END AS lr,
       CASE WHEN step < 300 THEN 0.85 + step / 300 * (0.95 - 0.85)
            WHEN step > 9950 THEN 0.95 - (step - 9950) / 50 * (0.95 - 0.85) ELSE 0.95 END AS momentum,
       step % 2 = 1 AS adam_step
FROM lk
""")
def h2_h4_schedule(spark, sf_dir):
    lk = _lookup(spark, sf_dir)
    s = F.col("step")
    return lk.select("step", F.col("idx").alias("stage"), "t", "batch_size", "max_seq_len", "ws_short", "ws_long",
                     sc.learning_rate(s, F.col("lr_mul")).alias("lr"), sc.momentum(s).alias("momentum"),
                     (F.pmod(s, F.lit(2)) == 1).alias("adam_step"))


@register("h5_mtp_weights", f"""
WITH {STAGES_SQL}
SELECT step, list_transform(list_zip(w_start, w_end), lambda p: p[1] + (p[2] - p[1]) * t) AS mtp_weights FROM lk
""")
def h5_mtp_weights(spark, sf_dir):
    lk = _lookup(spark, sf_dir)
    return lk.select("step", sc.interpolate(F.col("w_start"), F.col("w_end"), F.col("t")).alias("mtp_weights"))


@register("h7_transition_steps", f"""
WITH {STAGES_SQL},
tr AS (SELECT DISTINCT start_step + d AS step FROM stages, (VALUES (-2), (-1), (0), (1)) v(d) WHERE idx > 0)
SELECT s.step, tr.step IS NOT NULL AS near_transition, s.step = (967 | 1) AS split_step
FROM st s LEFT JOIN tr ON tr.step = s.step
""")
def h7_transition_steps(spark, sf_dir):
    bounds = sc.stage_bounds(sc.stage_table(spark))
    tr = F.broadcast(sc.transition_steps(bounds).select("step").distinct().withColumn("near", F.lit(True)))
    split = bounds.select(sc.split_step().alias("split")).where("split IS NOT NULL").first()["split"]
    return steps(spark, sf_dir).join(tr, "step", "left").select(
        "step", F.coalesce(F.col("near"), F.lit(False)).alias("near_transition"),
        (F.col("step") == F.lit(split)).alias("split_step"))


@register("b17_tokens_consumed", f"""
WITH {STAGES_SQL}
SELECT s.step, sum(greatest(least(s.step + 1, g.end_step) - g.start_step, 0) * g.batch_size)::BIGINT AS tokens_consumed
FROM st s, stages g GROUP BY s.step
""")
def b17_tokens_consumed(spark, sf_dir):
    return sc.tokens_consumed(steps(spark, sf_dir), sc.stage_bounds(sc.stage_table(spark)))
