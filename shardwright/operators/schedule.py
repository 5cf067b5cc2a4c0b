"""Training step plan.

The stage table has one row per stage (four here); it is joined to step
rows by a broadcast range join (``start <= step < end``), the one broadcast
whose size is fixed by the schedule, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (COOLDOWN_FRAC, MUON_COOLDOWN_STEPS, MUON_MOMENTUM_END, MUON_MOMENTUM_START,
                         MUON_WARMUP_STEPS, SCHEDULED_ITERATIONS, STAGES, TOTAL_STEPS)

STAGE_SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("duration", T.DoubleType()),
    T.StructField("lr_mul", T.DoubleType()), T.StructField("batch_size", T.IntegerType()),
    T.StructField("ws_short", T.IntegerType()), T.StructField("ws_long", T.IntegerType()),
    T.StructField("w_start", T.ArrayType(T.DoubleType())), T.StructField("w_end", T.ArrayType(T.DoubleType())),
    T.StructField("max_seq_len", T.IntegerType())])


def stage_table(spark: SparkSession, stages=STAGES) -> DataFrame:
    rows = [(i, d, lr, bs, a, b, list(ws), list(we), msl) for i, (d, lr, bs, a, b, ws, we, msl) in enumerate(stages)]
    return spark.createDataFrame(rows, STAGE_SCHEMA)


def stage_bounds(stages: DataFrame, scheduled: int = SCHEDULED_ITERATIONS, total: int = TOTAL_STEPS) -> DataFrame:
    """H1: ``end = round(cumsum(duration) * scheduled)`` (half to even, as
    Python rounds); the last (extension) stage ends at ``total``."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    cum = F.sum("duration").over(w)
    end = F.when(F.col("duration").isNull(), F.lit(total)) \
        .otherwise(F.bround(cum * scheduled, 0)).cast("long")
    b = stages.withColumn("end_step", end)
    return b.withColumn("start_step", F.coalesce(F.lag("end_step").over(Window.orderBy("idx")), F.lit(0)).cast("long"))


def lookup(steps: DataFrame, bounds: DataFrame, step_col: str = "step") -> DataFrame:
    """H2: stage of each step and the fraction ``t`` through it; after the
    last stage: the last stage with ``t = 1``."""
    last = bounds.agg(F.max("idx").alias("last_idx"), F.max("end_step").alias("last_end"))
    b = F.broadcast(bounds.crossJoin(last))
    s = F.col(step_col)
    cond = ((s >= F.col("start_step")) & (s < F.col("end_step"))) | \
        ((F.col("idx") == F.col("last_idx")) & (s >= F.col("last_end")))
    t = F.when(s >= F.col("end_step"), F.lit(1.0)) \
        .otherwise((s - F.col("start_step")) / (F.col("end_step") - F.col("start_step")))
    return steps.join(b, cond).withColumn("t", t).drop("last_idx", "last_end")


def learning_rate(step: Column, lr_mul: Column, scheduled: int = SCHEDULED_ITERATIONS,
                  cooldown_frac: float = COOLDOWN_FRAC, floor: float = 0.15) -> Column:
    """H3: stage lr, linear cool-down to ``floor`` from ``int(scheduled*(1-frac))``."""
    cd_start = int(scheduled * (1 - cooldown_frac))
    t = F.least(F.lit(1.0), (step - cd_start) / F.lit(float(scheduled - cd_start)))
    return F.when(step >= cd_start, lr_mul * (1 - t) + F.lit(floor) * t).otherwise(lr_mul)


def momentum(step: Column, total: int = TOTAL_STEPS) -> Column:
    """H4: warm-up 0.85 -> 0.95 over 300 steps, cool-down over the last 50."""
    lo, hi = MUON_MOMENTUM_START, MUON_MOMENTUM_END
    cd = total - MUON_COOLDOWN_STEPS
    return F.when(step < MUON_WARMUP_STEPS, lo + step / MUON_WARMUP_STEPS * (hi - lo)) \
        .when(step > cd, hi - (step - cd) / MUON_COOLDOWN_STEPS * (hi - lo)).otherwise(F.lit(hi))


def interpolate(w_start: Column, w_end: Column, t: Column) -> Column:
    """H5: element-wise ``a + (b - a) * t``."""
    return F.zip_with(w_start, w_end, lambda a, b: a + (b - a) * t)


def index_schedule(schedule: Column, step: Column, total: int) -> Column:
    """H6: ``schedule[int(len * step / total)]``, last entry after the end."""
    i = F.floor(F.size(schedule) * step / F.lit(total)).cast("int")
    return F.element_at(schedule, F.least(i, F.size(schedule) - 1) + 1)


def transition_steps(bounds: DataFrame) -> DataFrame:
    """H7: stage starts after the first, with neighbours -2..+1."""
    starts = bounds.where(F.col("idx") > 0).select(F.col("start_step").alias("transition"))
    return starts.select("transition", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 0, 1)])).alias("d")) \
        .select("transition", (F.col("transition") + F.col("d")).alias("step")).distinct()


def split_step(split_stage: int = 2) -> Column:
    """H7: first step of ``split_stage`` made odd (``| 1``); null for the other stages."""
    return F.when(F.col("idx") == split_stage, F.col("start_step").bitwiseOR(F.lit(1)))


def tokens_consumed(steps: DataFrame, bounds: DataFrame, step_col: str = "step") -> DataFrame:
    """Tokens trained after ``step`` (inclusive), summing each stage's
    batch size over its steps (closed form, no running window)."""
    b = bounds.select("start_step", "end_step", "batch_size")
    per = F.greatest(F.least(F.col(step_col) + 1, F.col("end_step")) - F.col("start_step"), F.lit(0)) * F.col("batch_size")
    return steps.crossJoin(F.broadcast(b)).groupBy(step_col).agg(F.sum(per).cast("long").alias("tokens_consumed"))
