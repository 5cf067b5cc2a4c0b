"""Run-log analytics and significance tests.

Everything is an aggregate per run or per run group; the only Python is the
t / chi-square CDF and quantile on the aggregated rows (``functions.stats``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NEVER_REACHED_PENALTY
from ..functions import stats


def final_val_loss(run_log: DataFrame) -> DataFrame:
    """Last validation loss of every run."""
    v = run_log.where(F.col("val_loss").isNotNull())
    return v.groupBy("run_id").agg(
        F.max("step").alias("final_step"),
        F.max_by("val_loss", "step").alias("final_val_loss"))


def loss_curve(run_log: DataFrame) -> DataFrame:
    """R2: val loss curve with step time = time difference to the previous
    val line, and ``step_avg = time / max(step, 1)``."""
    v = run_log.where(F.col("val_loss").isNotNull())
    w = Window.partitionBy("run_id").orderBy("step")
    return v.select(
        "run_id", "step", "val_loss", "train_time_ms",
        (F.col("train_time_ms") - F.lag("train_time_ms").over(w)).alias("dt_ms"),
        (F.col("train_time_ms").cast("double") / F.greatest(F.col("step"), F.lit(1))).alias("step_avg_ms"))


def time_to_target(run_log: DataFrame, target: float) -> DataFrame:
    """First train time with val loss <= target; penalty when never."""
    v = run_log.where(F.col("val_loss").isNotNull())
    t = F.min(F.when(F.col("val_loss") <= F.lit(target), F.col("train_time_ms")))
    return v.groupBy("run_id").agg(t.alias("t")).select(
        "run_id", F.coalesce(F.col("t").cast("double"), F.lit(NEVER_REACHED_PENALTY)).alias("time_to_target_ms"),
        F.col("t").isNotNull().alias("reached"))


def summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """N, mean, sample std, median, min, max."""
    x = F.col(value)
    return df.groupBy(*group).agg(
        F.count(x).cast("long").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.percentile(x, 0.5).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))


def t_statistic(mean: Column, std: Column, n: Column, target: float) -> Column:
    """One-sample t; null when n < 2 or zero variance."""
    return F.when((n >= 2) & (std > 0), (mean - F.lit(target)) / (std / F.sqrt(n.cast("double"))))


def one_sample_t(df: DataFrame, group: list[str], value: str, target: float) -> DataFrame:
    """R6 (t part): mean, std, n, t, df per group."""
    s = df.groupBy(*group).agg(F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("std"))
    return s.withColumn("t", t_statistic(F.col("mean"), F.col("std"), F.col("n"), target)) \
        .withColumn("df", (F.col("n") - 1).cast("double"))


def decision_record(tt: DataFrame, target: float, alpha: float = 0.01) -> DataFrame:
    """P (H1: mean < target), REJECT flag, one-sided upper bound
    ``mean + t(1-alpha)*s/sqrt(n)``, 99 % two-sided interval of the mean,
    90 % Bayesian intervals of mean and std."""
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    p = stats.p_less(F.col("t"), F.col("df"))
    t_hi = stats.t_ppf_udf(F.lit(1.0 - alpha), F.col("df"))
    t99 = stats.t_ppf_udf(F.lit(0.995), F.col("df"))
    t90 = stats.t_ppf_udf(F.lit(0.95), F.col("df"))
    n1 = F.col("n") - 1
    ss = F.col("std") * F.col("std") * n1
    chi_lo = stats.chi2_ppf_udf(F.lit(0.05), n1.cast("double"))
    chi_hi = stats.chi2_ppf_udf(F.lit(0.95), n1.cast("double"))
    return tt.select(
        "*", p.alias("p"), F.lit(alpha).alias("alpha"), (p < F.lit(alpha)).alias("reject"),
        (F.col("mean") + t_hi * se).alias("upper_bound"), F.lit(target).alias("threshold"),
        (F.col("mean") - t99 * se).alias("ci99_low"), (F.col("mean") + t99 * se).alias("ci99_high"),
        (F.col("mean") - t90 * se).alias("bayes90_mean_low"), (F.col("mean") + t90 * se).alias("bayes90_mean_high"),
        F.sqrt(ss / chi_hi).alias("bayes90_std_low"), F.sqrt(ss / chi_lo).alias("bayes90_std_high"))


def welch(a_mean: Column, a_var: Column, a_n: Column, b_mean: Column, b_var: Column, b_n: Column):
    """Welch's t and Welch-Satterthwaite degrees of freedom."""
    va = a_var / a_n
    vb = b_var / b_n
    t = (a_mean - b_mean) / F.sqrt(va + vb)
    df = (va + vb) * (va + vb) / (va * va / (a_n - 1) + vb * vb / (b_n - 1))
    return t, df


def variant_vs_baseline(runs: DataFrame, baseline: str, target: float) -> DataFrame:
    """Per variant n, means, std, deltas vs the baseline row
    (broadcast: one row), one-sample loss t vs target, two-sided Welch t and
    df on time; p-values by the t CDF.  The baseline's own Welch p is null."""
    agg = runs.groupBy("variant").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg("loss").alias("mean_loss"), F.stddev_samp("loss").alias("std_loss"),
        F.avg("time_s").alias("mean_time"), F.var_samp("time_s").alias("var_time"))
    base = agg.where(F.col("variant") == baseline).select(
        F.col("n").alias("b_n"), F.col("mean_loss").alias("b_loss"),
        F.col("mean_time").alias("b_time"), F.col("var_time").alias("b_var"))
    j = agg.crossJoin(F.broadcast(base))  # one baseline row
    t_w, df_w = welch(F.col("mean_time"), F.col("var_time"), F.col("n"), F.col("b_time"), F.col("b_var"), F.col("b_n"))
    is_base = F.col("variant") == F.lit(baseline)
    return j.select(
        "variant", "n", "mean_loss", "std_loss", "mean_time",
        (F.col("mean_loss") - F.col("b_loss")).alias("delta_loss"),
        (F.col("mean_time") - F.col("b_time")).alias("delta_time"),
        t_statistic(F.col("mean_loss"), F.col("std_loss"), F.col("n"), target).alias("t_loss"),
        F.when(is_base, F.lit(None)).otherwise(t_w).alias("t_time"),
        F.when(is_base, F.lit(None)).otherwise(df_w).alias("df_time"))


def with_p_values(vs: DataFrame) -> DataFrame:
    """Loss p (one-sided), time p (two-sided Welch), stars."""
    p_loss = stats.p_less(F.col("t_loss"), (F.col("n") - 1).cast("double"))
    p_time = stats.p_two_sided(F.col("t_time"), F.col("df_time"))
    stars = F.when(p_loss < 0.01, "**").when(p_loss < 0.05, "*").otherwise("")
    return vs.select("*", p_loss.alias("p_loss"), p_time.alias("p_time"), stars.alias("stars"))


def step_sweep(runs: DataFrame, baseline: str, target: float) -> DataFrame:
    """Per variant of ``(variant, run, steps, loss)`` its mean steps, their difference from the baseline's, and
    the one-sided p of its loss against ``target`` with stars (``*`` below 0.05, ``**`` below 0.01)."""
    steps = runs.groupBy("variant").agg(F.avg("steps").alias("steps"))
    base = steps.where(F.col("variant") == baseline).select(F.col("steps").alias("b_steps"))
    tests = one_sample_t(runs, ["variant"], "loss", target).withColumn("p", stats.p_less(F.col("t"), F.col("df")))
    stars = F.when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return tests.join(steps, "variant").crossJoin(F.broadcast(base)).select(  # one baseline row
        "variant", "n", "steps", (F.col("steps") - F.col("b_steps")).alias("delta_steps"), "mean", "p", stars.alias("stars"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Equal-width histogram counts."""
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / ((hi - lo) / n_bins)), F.lit(0)), F.lit(n_bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def sliding_t(runs: DataFrame, ord_col: str, value: str, width: int, target: float) -> DataFrame:
    """T of every window of ``width`` consecutive runs (``ord_col`` is a
    dense 1-based ordinal).  Window sums come from two-level prefix sums of
    the centred values and one equi-join on ``ord + width``, so no window
    ever spans the whole table."""
    from .ordering import prefix_sum
    c = runs.select(ord_col, (F.col(value) - F.lit(target)).alias("__x"))
    c = c.withColumn("__x2", F.col("__x") * F.col("__x"))
    c = prefix_sum(c, ord_col, "__x", "__s1", inclusive=True, out_type=None)
    c = prefix_sum(c, ord_col, "__x2", "__s2", inclusive=True, out_type=None)
    hi = c.select(F.col(ord_col).alias("__hi_ord"), F.col("__s1").alias("__h1"), F.col("__s2").alias("__h2"))
    lo = c.select((F.col(ord_col) + 1).alias("start_ord"), F.col("__s1").alias("__l1"), F.col("__s2").alias("__l2"))
    first = hi.where(F.col("__hi_ord") == width).select(F.lit(1).cast("long").alias("start_ord"),
                                                        F.col("__h1").alias("s1"), F.col("__h2").alias("s2"))
    j = lo.join(hi, hi["__hi_ord"] == lo["start_ord"] + (width - 1)).select(
        F.col("start_ord").cast("long").alias("start_ord"), (F.col("__h1") - F.col("__l1")).alias("s1"),
        (F.col("__h2") - F.col("__l2")).alias("s2"))
    w = j.unionByName(first)
    mean_c = F.col("s1") / width
    var = (F.col("s2") - F.col("s1") * F.col("s1") / width) / (width - 1)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return w.select("start_ord", F.lit(width).cast("long").alias("n"), (mean_c + F.lit(target)).alias("mean"),
                    std.alias("std"), F.when(std > 0, mean_c / (std / F.sqrt(F.lit(float(width))))).alias("t"))


def bootstrap_t(runs: DataFrame, ord_col: str, value: str, n_rows: int, n_samples: int, sample_size: int,
                target: float, seed: int = 0) -> DataFrame:
    """``n_samples`` resamples of ``sample_size`` runs with replacement;
    the draw is a hash of (seed, sample, j), so it is repeatable whatever the
    partitioning.  One t and p per sample."""
    spark = runs.sparkSession
    draws = spark.range(1, n_samples + 1).withColumnRenamed("id", "sample") \
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(sample_size))))
    draws = draws.withColumn(ord_col, (F.pmod(F.xxhash64(F.lit(seed), "sample", "j"), F.lit(n_rows)) + 1).cast("long"))
    j = draws.join(runs.select(F.col(ord_col).cast("long").alias(ord_col), value), ord_col)
    s = j.groupBy("sample").agg(F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"),
                                F.stddev_samp(value).alias("std"))
    s = s.withColumn("t", t_statistic(F.col("mean"), F.col("std"), F.col("n"), target)) \
        .withColumn("df", (F.col("n") - 1).cast("double"))
    return s.withColumn("p", stats.p_less(F.col("t"), F.col("df")))


MIX = (2246822519, 3266489917)  # odd multipliers of a public 32-bit finaliser


def _times32(a: Column, factor: int) -> Column:
    """``a * factor`` modulo 2**32 for 32-bit values, without overflow of a long."""
    two32 = F.lit(1 << 32).cast("long")
    return F.pmod(F.pmod(a * (factor >> 16), two32) * 65536 + a * (factor & 0xFFFF), two32)


def mixed32(x: Column) -> Column:
    """A 32-bit hash of a non-negative number below 2**32, in integer arithmetic that SQL can repeat."""
    h = _times32(x.bitwiseXOR(F.shiftright(x, 15)), MIX[0])
    h = _times32(h.bitwiseXOR(F.shiftright(h, 13)), MIX[1])
    return h.bitwiseXOR(F.shiftright(h, 16))


def bootstrap_variants(runs: DataFrame, group: str, ord_col: str, value: str, n_samples: int, sample_size: int,
                       target: float, seed: int = 0) -> DataFrame:
    """R10 for every group at once: ``n_samples`` resamples of ``sample_size`` of its runs, with replacement.

    ``ord_col`` counts a group's runs from 1.  Draw ``j`` of a sample is a hash of (seed,
    sample, j) scaled to the group's size; all groups share one draw table, one
    equi-join and one aggregate.  One t and p per (group, sample).
    """
    sizes = runs.groupBy(group).agg(F.max(ord_col).alias("__size"))
    draws = runs.sparkSession.range(n_samples * sample_size).select(
        F.floor(F.col("id") / sample_size).alias("sample"), mixed32(F.col("id") + seed * n_samples * sample_size).alias("__h"))
    # one row per group beside the draws: a product of two parameters and the number of variants
    picked = draws.crossJoin(F.broadcast(sizes)).withColumn(
        ord_col, F.shiftright(F.col("__h") * F.col("__size"), 32) + 1)
    s = picked.join(runs.select(group, F.col(ord_col).cast("long").alias(ord_col), value), [group, ord_col]).groupBy(group, "sample").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    t = t_statistic(F.col("mean"), F.col("std"), F.col("n"), target)
    return s.withColumn("t", t).withColumn("p", stats.p_less(F.col("t"), (F.col("n") - 1).cast("double")))


def bootstrap_summary(samples: DataFrame, level: float = 0.01, group: list[str] | None = None) -> DataFrame:
    """Mean / max / variance of p and the share below ``level``, over all samples or per group."""
    return samples.groupBy(*(group or [])).agg(F.avg("p").alias("mean_p"), F.max("p").alias("max_p"), F.var_samp("p").alias("var_p"),
                       F.avg((F.col("p") < level).cast("double")).alias("share_below"))


def record_progression(records: DataFrame) -> DataFrame:
    """Per track in record order: gain vs the prior record, running best
    and speed-up over the first record (a track has at most a few hundred
    records, so the window per track is small)."""
    w = Window.partitionBy("track").orderBy("num")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return records.select(
        "track", "num", "minutes",
        (F.lag("minutes").over(w) - F.col("minutes")).alias("gain"),
        F.min("minutes").over(run).alias("best_so_far"),
        (F.first("minutes").over(run) / F.col("minutes")).alias("speedup"))


def contributor_counts(records: DataFrame) -> DataFrame:
    """Records per contributor."""
    return records.select("track", F.explode("contributors").alias("contributor")) \
        .groupBy("contributor").agg(F.count(F.lit(1)).cast("long").alias("n_records"))


def retime(official_prior: Column, prior_retimed: Column, new_measured: Column) -> Column:
    """New time = official prior - (prior re-timed - new measured)."""
    return official_prior - (prior_retimed - new_measured)


def record_rule(mean: Column, p: Column, target: float, time_new: Column, time_prior: Column) -> Column:
    """A record needs mean <= target with p < 0.01 and a faster time."""
    return (mean <= F.lit(target)) & (p < F.lit(0.01)) & (time_new < time_prior)


def record_check(runs: DataFrame, records: DataFrame, baseline: str, target: float) -> DataFrame:
    """R16 with R6, R17 and R18: which variants of ``(variant, run, loss, time_s)`` set a record.

    The loss counts by its one-sided t-test against ``target``.  The prior time is the
    best of the record table; the baseline variant is the prior record run again on this machine,
    and what a variant gains on it is taken off the prior time.
    """
    tests = one_sample_t(runs, ["variant"], "loss", target).select(
        "variant", "n", "mean", stats.p_less(F.col("t"), F.col("df")).alias("p"))
    times = runs.groupBy("variant").agg(F.avg("time_s").alias("time_s"))
    prior = record_progression(records).agg(F.min("best_so_far").alias("prior_minutes"))
    again = times.where(F.col("variant") == baseline).select(F.col("time_s").alias("prior_again_s"))
    rows = tests.join(times, "variant").crossJoin(F.broadcast(prior)).crossJoin(F.broadcast(again))  # one row each
    minutes = retime(F.col("prior_minutes"), F.col("prior_again_s") / 60, F.col("time_s") / 60)
    return rows.withColumn("minutes", minutes).select(
        "variant", "n", "mean", "p", "minutes", "prior_minutes",
        record_rule(F.col("mean"), F.col("p"), target, F.col("minutes"), F.col("prior_minutes")).alias("is_record"))


def time_to_target_summary(times: DataFrame, group: str, limit_ms: float) -> DataFrame:
    """R15 per configuration: mean and deviation of its runs' times, PASS if all reached the target within the limit on average."""
    agg = times.groupBy(group).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("time_to_target_ms").alias("mean_ms"),
                                   F.stddev_samp("time_to_target_ms").alias("std_ms"), F.bool_and("reached").alias("all_reached"))
    passed = F.col("all_reached") & (F.col("mean_ms") <= limit_ms)
    return agg.withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))


def loss_per_shard(shard_rows: DataFrame) -> DataFrame:
    """Loss per shard (rows) and experiment (columns); ``shard_rows`` from
    the loss-log view ``shards`` with ``run_id`` as the experiment name."""
    exps = [r[0] for r in shard_rows.select("run_id").distinct().orderBy("run_id").collect()]
    return shard_rows.groupBy("shard_name").pivot("run_id", exps).agg(F.first("val_loss"))


def compare_experiments(step_rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Final loss (last step row) of each experiment next to its
    evaluation accuracy; ranked by loss and by accuracy."""
    final = step_rows.groupBy(F.col("run_id").alias("exp")).agg(F.max_by("val_loss", "step").alias("final_loss"))
    j = final.join(bench.select("exp", "accuracy"), "exp", "left")
    return j.withColumn("loss_rank", F.rank().over(Window.orderBy("final_loss"))) \
        .withColumn("accuracy_rank", F.rank().over(Window.orderBy(F.col("accuracy").desc())))
