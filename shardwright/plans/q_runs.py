"""Registered queries: run-log analytics.

Stand-in logs come from ``events``: one run per user, its events in
``(ts, event_id)`` order are the logged steps; ``val_loss = 3 +
floor(value)/1000``; ``train_time = 250*step + floor(value) mod 200`` ms.
The Spark side writes the trainer's text lines and parses them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TARGET_LOSS_SHORT
from ..operators import runs as rn
from ..operators.ordering import global_row_number
from ..registry import register
from ..sources import logs
from ..sources.tables import read_table

TARGET = TARGET_LOSS_SHORT
BASELINE_VARIANT = "view"


def run_log_lines(spark, sf_dir):
    """``(run_id, value)`` text lines in the trainer's log format."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    ev = global_row_number(ev, [F.col("ts").asc(), F.col("event_id").asc()], "step", partition_cols=["user_id"])
    total = ev.groupBy("user_id").agg(F.max("step").alias("total"))
    ev = ev.join(total, "user_id")
    fv = F.floor("value").cast("long")
    ttime = F.col("step") * 250 + F.pmod(fv, F.lit(200))
    val = F.format_string("step:%d/%d val_loss:%.4f train_time:%dms step_avg:%.2fms",
                          F.col("step"), F.col("total"), F.lit(3.0) + fv / 1000.0, ttime,
                          ttime / F.greatest(F.col("step"), F.lit(1)))
    train = F.format_string("step:%d/%d train_time:%dms step_avg:%.2fms",
                            F.col("step"), F.col("total"), ttime, ttime / F.greatest(F.col("step"), F.lit(1)))
    lines = F.when(F.col("event_type") == "click", F.array(val, train)).otherwise(F.array(val))
    return ev.select(F.col("user_id").cast("string").alias("run_id"), F.explode(lines).alias("value"))


def run_log(spark, sf_dir):
    return logs.parse_run_log(run_log_lines(spark, sf_dir))


RUNLOG = """
ev AS (SELECT user_id::VARCHAR AS run_id, event_type, floor(value)::BIGINT AS fv,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
tot AS (SELECT run_id, max(step) AS total FROM ev GROUP BY run_id),
vals AS (SELECT e.run_id, e.step::BIGINT AS step, t.total::BIGINT AS total, 3.0 + e.fv / 1000.0 AS val_loss,
                (e.step * 250 + e.fv % 200)::BIGINT AS train_time_ms
         FROM ev e JOIN tot t USING (run_id))"""


@register("s12_run_log_parse", f"""
WITH {RUNLOG}
SELECT run_id, 'val' AS kind, step, total, val_loss, NULL::DOUBLE AS train_loss, train_time_ms FROM vals
UNION ALL
SELECT v.run_id, 'train', v.step, v.total, NULL::DOUBLE, NULL::DOUBLE, v.train_time_ms
FROM vals v JOIN ev e ON e.run_id = v.run_id AND e.step = v.step WHERE e.event_type = 'click'
""")
def s12_run_log_parse(spark, sf_dir):
    return run_log(spark, sf_dir).drop("step_avg_ms")


@register("r1_final_val_loss", f"""
WITH {RUNLOG}
SELECT run_id, max(step) AS final_step, arg_max(val_loss, step) AS final_val_loss FROM vals GROUP BY run_id
""")
def r1_final_val_loss(spark, sf_dir):
    return rn.final_val_loss(run_log(spark, sf_dir))


@register("r2_loss_curve", f"""
WITH {RUNLOG}
SELECT run_id, step, val_loss, train_time_ms,
       train_time_ms - lag(train_time_ms) OVER (PARTITION BY run_id ORDER BY step) AS dt_ms,
       train_time_ms::DOUBLE / greatest(step, 1) AS step_avg_ms
FROM vals
""")
def r2_loss_curve(spark, sf_dir):
    return rn.loss_curve(run_log(spark, sf_dir))


@register("r15_time_to_target", f"""
WITH {RUNLOG}
SELECT run_id, coalesce(min(train_time_ms) FILTER (WHERE val_loss <= {TARGET})::DOUBLE, 999999.0) AS time_to_target_ms,
       count(*) FILTER (WHERE val_loss <= {TARGET}) > 0 AS reached
FROM vals GROUP BY run_id
""")
def r15_time_to_target(spark, sf_dir):
    return rn.time_to_target(run_log(spark, sf_dir), TARGET)


RUNS_A_CONFIG, LIMIT_MS = 3, 60_000


@register("r15_target_verdict", f"""
WITH {RUNLOG},
t AS (SELECT run_id, coalesce(min(train_time_ms) FILTER (WHERE val_loss <= {TARGET})::DOUBLE, 999999.0) AS ms,
             count(*) FILTER (WHERE val_loss <= {TARGET}) > 0 AS reached FROM vals GROUP BY run_id),
c AS (SELECT run_id::BIGINT // {RUNS_A_CONFIG} AS config, count(*) AS n_runs, avg(ms) AS mean_ms, stddev_samp(ms) AS std_ms,
             bool_and(reached) AS all_reached FROM t GROUP BY 1)
SELECT config::BIGINT AS config, n_runs::BIGINT AS n_runs, mean_ms, std_ms, all_reached,
       CASE WHEN all_reached AND mean_ms <= {LIMIT_MS} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c
""")
def r15_target_verdict(spark, sf_dir):
    """Mean and deviation of the time to target over the runs of a configuration: three runs in a row here."""
    times = rn.time_to_target(run_log(spark, sf_dir), TARGET)
    return rn.time_to_target_summary(times.withColumn("config", F.floor(F.col("run_id").cast("long") / RUNS_A_CONFIG).cast("long")),
                                     "config", LIMIT_MS)


def final_losses(spark, sf_dir):
    """``(variant, run, loss, time_s)`` per (event type, user)."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type", "value"])
    return ev.groupBy(F.col("event_type").alias("variant"), F.col("user_id").alias("run")).agg(
        (F.lit(3.2) + F.avg("value") / 1000.0).alias("loss"), (F.lit(90.0) + F.max("value") / 100.0).alias("time_s"))


FINAL = """
fl AS (SELECT event_type AS variant, user_id AS run, 3.2 + avg(value) / 1000.0 AS loss, 90.0 + max(value) / 100.0 AS time_s
       FROM events GROUP BY event_type, user_id)"""


# one-sided p of ``tt(t, df, ...)``: Simpson's rule over the t density from 0 to |t|
P_LESS = """
SELECT *, 0.5 + sign(t) * (abs(t) / 4000 / 3) * list_sum(list_transform(range(4001), lambda k:
       (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
       * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + (k * abs(t) / 4000) ^ 2 / df)))) AS p
FROM tt"""


@register("r4_r5_summary", f"""
WITH {FINAL}
SELECT variant, count(loss)::BIGINT AS n, avg(loss) AS mean, stddev_samp(loss) AS std,
       quantile_cont(loss, 0.5) AS median, min(loss) AS min, max(loss) AS max
FROM fl GROUP BY variant
""")
def r4_r5_summary(spark, sf_dir):
    return rn.summary(final_losses(spark, sf_dir), ["variant"], "loss")


@register("r6_t_statistic", f"""
WITH {FINAL}
SELECT variant, count(loss)::BIGINT AS n, avg(loss) AS mean, stddev_samp(loss) AS std,
       (avg(loss) - {TARGET}) / (stddev_samp(loss) / sqrt(count(loss))) AS t, (count(loss) - 1)::DOUBLE AS df
FROM fl GROUP BY variant
""")
def r6_t_statistic(spark, sf_dir):
    return rn.one_sample_t(final_losses(spark, sf_dir), ["variant"], "loss", TARGET)


@register("r7_decision_record")
def r7_decision_record(spark, sf_dir):
    # p, REJECT, upper bound, 99 % interval, Bayesian intervals (R6-R9);
    # distribution functions have no SQL form: checked against golden values in tests
    tt = rn.one_sample_t(final_losses(spark, sf_dir), ["variant"], "loss", TARGET)
    return rn.decision_record(tt, TARGET)


@register("r12_variant_vs_baseline", f"""
WITH {FINAL},
agg AS (SELECT variant, count(*)::BIGINT AS n, avg(loss) AS mean_loss, stddev_samp(loss) AS std_loss,
               avg(time_s) AS mean_time, var_samp(time_s) AS var_time FROM fl GROUP BY variant),
b AS (SELECT n AS b_n, mean_loss AS b_loss, mean_time AS b_time, var_time AS b_var FROM agg WHERE variant = '{BASELINE_VARIANT}')
SELECT variant, n, mean_loss, std_loss, mean_time, mean_loss - b_loss AS delta_loss, mean_time - b_time AS delta_time,
       (mean_loss - {TARGET}) / (std_loss / sqrt(n)) AS t_loss,
       CASE WHEN variant = '{BASELINE_VARIANT}' THEN NULL
            ELSE (mean_time - b_time) / sqrt(var_time / n + b_var / b_n) END AS t_time,
       CASE WHEN variant = '{BASELINE_VARIANT}' THEN NULL
            ELSE (var_time / n + b_var / b_n) ^ 2 / ((var_time / n) ^ 2 / (n - 1) + (b_var / b_n) ^ 2 / (b_n - 1)) END AS df_time
FROM agg, b
""")
def r12_variant_vs_baseline(spark, sf_dir):
    return rn.variant_vs_baseline(final_losses(spark, sf_dir), BASELINE_VARIANT, TARGET)


@register("r13_r14_p_values")
def r13_r14_p_values(spark, sf_dir):
    return rn.with_p_values(rn.variant_vs_baseline(final_losses(spark, sf_dir), BASELINE_VARIANT, TARGET))


SWEEP_TARGET = 3.2525


@register("r14_step_sweep", f"""
WITH r AS (SELECT event_type AS variant, user_id, count(*) AS steps, 3.2 + avg(value) / 1000.0 AS loss
           FROM events GROUP BY event_type, user_id),
tt AS (SELECT variant, count(*) AS n, avg(steps) AS steps, avg(loss) AS mean, (count(*) - 1)::DOUBLE AS df,
              (avg(loss) - {SWEEP_TARGET}) / (stddev_samp(loss) / sqrt(count(*))) AS t FROM r GROUP BY variant),
tested AS ({P_LESS})
SELECT variant, n::BIGINT AS n, steps, steps - (SELECT steps FROM tt WHERE variant = '{BASELINE_VARIANT}') AS delta_steps, mean,
       round(greatest(p, 0.0), 5) AS p, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
FROM tested
""")
def r14_step_sweep(spark, sf_dir):
    """Step counts of the event types against the baseline's, with the loss test's stars."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type", "value"])
    runs = ev.groupBy(F.col("event_type").alias("variant"), F.col("user_id").alias("run")).agg(
        F.count(F.lit(1)).alias("steps"), (F.lit(3.2) + F.avg("value") / 1000.0).alias("loss"))
    out = rn.step_sweep(runs, BASELINE_VARIANT, SWEEP_TARGET)
    return out.withColumn("p", F.round(F.greatest("p", F.lit(0.0)), 5))


@register("r20_loss_histogram", f"""
WITH {FINAL}
SELECT least(greatest(floor((loss - 3.2) / (0.3 / 30)), 0), 29)::INTEGER AS bin, count(*)::BIGINT AS n
FROM fl GROUP BY 1
""")
def r20_loss_histogram(spark, sf_dir):
    return rn.histogram(final_losses(spark, sf_dir), "loss", 3.2, 3.5, 30)


def _ordered_variant(spark, sf_dir, variant="click"):
    fl = final_losses(spark, sf_dir).where(F.col("variant") == variant)
    return global_row_number(fl, [F.col("run").asc()], "run_ord")


@register("r11_sliding_t", f"""
WITH {FINAL},
o AS (SELECT loss, row_number() OVER (ORDER BY run) AS run_ord FROM fl WHERE variant = 'click'),
w AS (SELECT run_ord AS start_ord, count(loss) OVER (ORDER BY run_ord ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS n,
             avg(loss) OVER (ORDER BY run_ord ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS mean,
             stddev_samp(loss) OVER (ORDER BY run_ord ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS std FROM o)
SELECT start_ord::BIGINT AS start_ord, n::BIGINT AS n, mean, std, (mean - {TARGET}) / (std / sqrt(40)) AS t
FROM w WHERE n = 40
""")
def r11_sliding_t(spark, sf_dir):
    return rn.sliding_t(_ordered_variant(spark, sf_dir), "run_ord", "loss", 40, TARGET)


@register("r10_bootstrap")
def r10_bootstrap(spark, sf_dir):
    runs = _ordered_variant(spark, sf_dir)
    n = runs.count()
    return rn.bootstrap_summary(rn.bootstrap_t(runs, "run_ord", "loss", n, 1000, 40, TARGET, seed=0))


def _times32_sql(a: str, factor: int) -> str:
    return f"((({a}) * {factor >> 16} % 4294967296) * 65536 + ({a}) * {factor & 0xFFFF}) % 4294967296"


N_SAMPLES, SAMPLE_SIZE = 1000, 40


@register("r10_bootstrap_variants", f"""
WITH {FINAL},
o AS (SELECT variant, loss, row_number() OVER (PARTITION BY variant ORDER BY run) AS run_ord FROM fl),
sz AS (SELECT variant, count(*) AS n_runs FROM o GROUP BY variant),
h0 AS (SELECT id, {_times32_sql("xor(id, id >> 15)", rn.MIX[0])} AS h FROM range({N_SAMPLES * SAMPLE_SIZE}) t(id)),
h1 AS (SELECT id, {_times32_sql("xor(h, h >> 13)", rn.MIX[1])} AS h FROM h0),
draws AS (SELECT id // {SAMPLE_SIZE} AS sample, variant, ((xor(h, h >> 16) * n_runs) >> 32) + 1 AS run_ord FROM h1, sz),
tt AS (SELECT variant, sample, (count(*) - 1)::DOUBLE AS df,
              (avg(loss) - {TARGET}) / (stddev_samp(loss) / sqrt(count(*))) AS t
       FROM draws JOIN o USING (variant, run_ord) GROUP BY variant, sample),
p AS ({P_LESS})
SELECT variant, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p, round(var_samp(p), 6) AS var_p,
       avg((p < 0.01)::INTEGER::DOUBLE) AS share_below
FROM p GROUP BY variant
""")
def r10_bootstrap_variants(spark, sf_dir):
    """The bootstrap of the loss test for every event type."""
    runs = global_row_number(final_losses(spark, sf_dir), [F.col("run").asc()], "run_ord", partition_cols=["variant"])
    samples = rn.bootstrap_variants(runs, "variant", "run_ord", "loss", N_SAMPLES, SAMPLE_SIZE, TARGET)
    out = rn.bootstrap_summary(samples, group=["variant"])
    return out.select("variant", *[F.round(c, 6).alias(c) for c in ("mean_p", "max_p", "var_p")], "share_below")
