"""Follow run logs as lines arrive (Structured Streaming).

Text files of trainer logs land in a folder; the stream parses them (S12)
and keeps per-run state: latest step and val loss, best val loss, first
train time at or below the target.  State is one small row per run
(``applyInPandasWithState``, update mode), so it never grows with the
number of lines.  The result equals R1 / R15 over the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.logs import parse_run_log

OUT_SCHEMA = "run_id string, final_step long, final_val_loss double, best_val_loss double, " \
             "time_to_target_ms double, reached boolean"
STATE_SCHEMA = "step long, val_loss double, best double, t_target long"


def _update(target: float, penalty: float):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.exists:
            step, val, best, t_target = state.get
        else:
            step, val, best, t_target = -1, float("nan"), float("inf"), None
        for pdf in batches:
            order = pdf["step"].to_numpy().argsort(kind="stable")  # a frame sorted per run costs more than its rows
            for s, v, t in zip(*(pdf[c].to_numpy()[order].tolist() for c in ("step", "val_loss", "train_time_ms"))):
                if s >= step:
                    step, val = int(s), float(v)
                best = min(best, float(v))
                if v <= target and (t_target is None or t < t_target):
                    t_target = int(t)
        state.update((step, val, best, t_target))
        yield pd.DataFrame([{
            "run_id": key[0], "final_step": step, "final_val_loss": val, "best_val_loss": best,
            "time_to_target_ms": float(t_target) if t_target is not None else penalty,
            "reached": t_target is not None}])
    return fn


def follow(lines: DataFrame, target: float, penalty: float = 999999.0) -> DataFrame:
    """Streaming (or batch) lines ``(run_id, value)`` -> per-run state rows."""
    vals = parse_run_log(lines).where(F.col("kind") == "val").select("run_id", "step", "val_loss", "train_time_ms")
    return vals.groupBy("run_id").applyInPandasWithState(
        _update(target, penalty), OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, log_dir: str, checkpoint: str, out_path: str, target: float,
                  run_pattern: str | None = r"([^/]+?)(\.[^./]*)?$", files_per_trigger: int = 1000) -> DataFrame:
    """Process every file now in ``log_dir`` (availableNow trigger, ``files_per_trigger`` files a micro-batch) and
    return the latest state row per run as a batch frame.

    The run's id is what ``run_pattern`` finds in a file's path.  Without a pattern a file holds lines
    of many runs, each behind its run's id and a tab, so that the files grow with the lines, not with the runs.
    A micro-batch owns the folder of its number under ``out_path`` and overwrites it, so one that is run again
    after a failure leaves no row twice.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(log_dir)
    if run_pattern is None:
        lines = lines.select(F.substring_index("value", "\t", 1).alias("run_id"),
                             F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))
    else:
        lines = lines.select(F.regexp_extract(F.input_file_name(), run_pattern, 1).alias("run_id"), "value")
    result = follow(lines, target)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = result.writeStream.outputMode("update").foreachBatch(sink) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(out_path)
    latest = out.groupBy("run_id").agg(F.max("epoch").alias("epoch"))
    return out.join(latest, ["run_id", "epoch"]).drop("epoch")
