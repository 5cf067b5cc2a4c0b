"""Text-log sources (S12-S17): trainer logs, loss logs, bench logs, record
tables.  Lines are read with ``spark.read.text`` and parsed with regular
expressions in the JVM; a line that does not parse is dropped from the typed
view (kept in the raw text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: trainer log line formats
NUMBER = r"([0-9.]+|nan|-?inf)"  # a diverged run logs nan or inf
VAL_LINE = rf"^step:(\d+)/(\d+) val_loss:{NUMBER} train_time:(\d+)ms step_avg:{NUMBER}ms"
TRAIN_LINE = rf"^step:(\d+)/(\d+) (?:train_loss:{NUMBER} )?train_time:(\d+)ms step_avg:{NUMBER}ms"
COMPACT_LINE = rf"^s:(\d+) tel:{NUMBER}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, value)``: run id from the file name (without extension)."""
    return spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("run_id"), "value")


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Val lines and train lines; the script source printed at the top
    of a log never matches the anchored patterns."""
    v = F.col("value")
    is_val = v.rlike(VAL_LINE)
    is_train = v.rlike(TRAIN_LINE)
    step = F.when(is_val, F.regexp_extract(v, VAL_LINE, 1)).otherwise(F.regexp_extract(v, TRAIN_LINE, 1))
    total = F.when(is_val, F.regexp_extract(v, VAL_LINE, 2)).otherwise(F.regexp_extract(v, TRAIN_LINE, 2))
    val_loss = F.when(is_val, F.regexp_extract(v, VAL_LINE, 3))
    train_loss = F.when(~is_val, F.regexp_extract(v, TRAIN_LINE, 3))
    ttime = F.when(is_val, F.regexp_extract(v, VAL_LINE, 4)).otherwise(F.regexp_extract(v, TRAIN_LINE, 4))
    savg = F.when(is_val, F.regexp_extract(v, VAL_LINE, 5)).otherwise(F.regexp_extract(v, TRAIN_LINE, 5))

    def num(c, t):
        return F.when(c == "", F.lit(None).cast(t)).otherwise(c.try_cast(t))

    return lines.where(is_val | is_train).select(
        "run_id", F.when(is_val, "val").otherwise("train").alias("kind"),
        num(step, "long").alias("step"), num(total, "long").alias("total"),
        num(val_loss, "double").alias("val_loss"), num(train_loss, "double").alias("train_loss"),
        num(ttime, "long").alias("train_time_ms"), num(savg, "double").alias("step_avg_ms"))


def parse_compact_log(lines: DataFrame) -> DataFrame:
    """``s:<step> tel:<loss>`` lines."""
    v = F.col("value")
    return lines.where(v.rlike(COMPACT_LINE)).select(
        "run_id", F.regexp_extract(v, COMPACT_LINE, 1).try_cast("long").alias("step"),
        F.regexp_extract(v, COMPACT_LINE, 2).try_cast("double").alias("val_loss"))


def parse_loss_log(lines: DataFrame) -> dict[str, DataFrame]:
    """One text source, three typed views.

    ``step,val_loss`` header is skipped; ``s,loss`` -> steps;
    ``shard,<name>,loss`` -> shards; ``last step s, error e`` -> ends.
    """
    v = F.col("value")
    parts = F.split(v, ",")
    is_end = v.rlike(r"^last step \d+, error ")
    is_shard = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "shard")
    is_step = (F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike(r"^\d+$") & ~is_end
    steps = lines.where(is_step).select("run_id", F.get(parts, F.lit(0)).try_cast("long").alias("step"),
                                        F.get(parts, F.lit(1)).try_cast("double").alias("val_loss"))
    shards = lines.where(is_shard).select("run_id", F.get(parts, F.lit(1)).alias("shard_name"),
                                          F.get(parts, F.lit(2)).try_cast("double").alias("val_loss"))
    ends = lines.where(is_end).select(
        "run_id", F.regexp_extract(v, r"^last step (\d+), error (.*)$", 1).try_cast("long").alias("step"),
        F.regexp_extract(v, r"^last step (\d+), error (.*)$", 2).alias("error"))
    return {"steps": steps, "shards": shards, "ends": ends}


BENCH_SCHEMA = T.StructType([
    T.StructField("exp", T.StringType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("n_correct", T.LongType()), T.StructField("n_count", T.LongType())])


def read_bench_log(spark: SparkSession, path: str) -> DataFrame:
    """``exp,accuracy,n_correct,n_count`` lines, explicit schema."""
    return spark.read.schema(BENCH_SCHEMA).option("header", "false").csv(path)


def format_bench_rows(df: DataFrame) -> DataFrame:
    """S15 sink format: ``exp,accuracy(3 significant),n_correct,n_count``."""
    return df.select(F.concat_ws(",", "exp", F.format_number("accuracy", 3), "n_correct", "n_count").alias("value"))


def parse_record_table(lines: DataFrame, track: str) -> DataFrame:
    """Record rows of a markdown pipe table: ``num | time | description | date | log | contributors``
    (outer pipes optional).

    Links are stripped to their text; minutes from ``x minutes`` / ``x hours``.
    """
    v = F.regexp_replace(F.regexp_replace(F.trim(F.col("value")), r"^\|\s*", ""), r"\s*\|$", "")
    cells = F.split(v, r"\s*\|\s*")
    row = lines.where(v.rlike(r"^\d+\s*\|"))

    def strip_links(c):
        return F.trim(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"))

    time_txt = strip_links(F.get(cells, 1))
    num = F.regexp_extract(time_txt, r"([0-9.]+)", 1).try_cast("double")
    minutes = F.when(time_txt.rlike("(?i)hour"), num * 60).otherwise(num)
    date_txt = strip_links(F.get(cells, 3))
    return row.select(
        F.lit(track).alias("track"), strip_links(F.get(cells, 0)).try_cast("int").alias("num"),
        minutes.alias("minutes"), strip_links(F.get(cells, 2)).alias("description"),
        F.try_to_timestamp(date_txt, F.lit("MM/dd/yy")).cast("date").alias("date"),
        F.filter(F.transform(F.split(strip_links(F.get(cells, 5)), r"\s*(,|&| and )\s*"), lambda x: F.trim(x)),
                 lambda x: x != "").alias("contributors"))


CHANNELS = ("run", "loss", "bench")


def write_channels(lines: DataFrame, path: str) -> None:
    """Append ``(channel, value)`` lines to one folder per channel; another channel's name raises."""
    known = F.col("channel").isin(*CHANNELS)
    checked = F.when(known, F.col("channel")).otherwise(
        F.raise_error(F.concat(F.lit(f"channels are {CHANNELS}, not "), F.coalesce("channel", F.lit("null")))))
    lines.select(checked.cast("string").alias("channel"), "value").write.mode("append").partitionBy("channel").text(path)


def read_channel(spark: SparkSession, path: str, channel: str) -> DataFrame:
    return spark.read.text(f"{path}/channel={channel}").select("value")


TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.LongType(), False), T.StructField("ctx", T.StringType()),
    T.StructField("endings", T.ArrayType(T.StringType())), T.StructField("label", T.IntegerType())])


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice tasks, one JSON object a line; a line that is no task raises."""
    return spark.read.schema(TASK_SCHEMA).option("mode", "FAILFAST").json(path)
