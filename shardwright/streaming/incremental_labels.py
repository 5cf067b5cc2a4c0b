"""Label only what newly arrived scores bring among the extremes (Structured Streaming).

A file stream over the metrics CSVs feeds two tables in the output folder:

* ``state/epoch=k``: the best and worst ``n`` documents per metric of all scores seen
  up to micro-batch ``k``, made from the state before it and the new rows alone, since
  the extremes of a union are among the extremes of its parts.  It has two times ``n``
  rows per metric, however many scores have passed.
* ``labels/epoch=k``: the answers for documents that entered the state in micro-batch
  ``k`` and had no answer from an earlier one.  Only these are cut from their shards
  and reach the classifier.

Each micro-batch overwrites its own ``epoch=k`` and reads only earlier ones, so one
that runs again after a failure gives the same tables.  A document that leaves
the extremes and returns is not asked about again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HEADER_TOKENS, NON_RANDOM_METRICS, PATTERN_FIELDS
from ..operators import labels as lb
from ..operators import selection as sel
from ..operators import span_cursor as cursor
from ..session import cut_lineage
from ..sources import files
from ..sources.metrics import METRICS_SCHEMA
from .incremental import without_header

STATE = ["metric", "value", "shard_stem", "start_idx", "end_idx"]
DOCUMENT = ["shard_stem", "start_idx"]


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """Micro-batches that have written to a table."""
    return sorted(int(p.rsplit("epoch=", 1)[1]) for p in files.matching(spark, f"{folder}/epoch=*"))


def _read(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{folder}/epoch={k}" for k in numbers]) if numbers else None


def label_batch(spark: SparkSession, scores: DataFrame, epoch: int, shard_dir: str, out: str,
                classifier: Callable[[str], dict], n: int, metrics: list[str]) -> None:
    """One micro-batch: new extremes, then answers for the documents among them that have none."""
    enough = scores.where("has_enough_tokens").select("shard_stem", "start_idx", "end_idx", *metrics)
    pool = sel.long_form(enough, metrics).select(STATE)
    before = _read(spark, f"{out}/state", [k for k in epochs(spark, f"{out}/state") if k < epoch][-1:])
    if before is not None:
        pool = pool.unionByName(before.select(STATE).distinct())
    sel.extremes(pool, n).write.mode("overwrite").parquet(f"{out}/state/epoch={epoch}")
    entered = spark.read.parquet(f"{out}/state/epoch={epoch}").select(*DOCUMENT, "end_idx").distinct()
    done = _read(spark, f"{out}/labels", [k for k in epochs(spark, f"{out}/labels") if k < epoch])
    if done is not None:
        entered = entered.join(done.select(*DOCUMENT), DOCUMENT, "left_anti")
    spans = entered.select("shard_stem", without_header("start_idx").alias("start_idx"), without_header("end_idx").alias("end_idx"))
    # the texts are few; cut once, so that the classifier's tasks start from stored rows
    texts = cut_lineage(cursor.decode_spans(spans, shard_dir))
    answers = lb.classify(texts, classifier).select(
        "shard_stem", (F.col("start_idx") + HEADER_TOKENS).alias("start_idx"), *PATTERN_FIELDS)
    answers.write.mode("overwrite").parquet(f"{out}/labels/epoch={epoch}")


def label_new_scores(spark: SparkSession, metrics_dir: str, shard_dir: str, out: str, checkpoint: str,
                     classifier: Callable[[str], dict], n: int, metrics: list[str] | None = None,
                     files_per_trigger: int | None = None) -> None:
    """Follow the metrics CSVs that have arrived since the checkpoint."""
    stream = spark.readStream.schema(METRICS_SCHEMA).option("header", "true").option("pathGlobFilter", "*.csv")
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    rows = stream.csv(metrics_dir).withColumn("shard_stem", stem)

    def batch(df: DataFrame, epoch: int) -> None:
        label_batch(spark, df, epoch, shard_dir, out, classifier, n, metrics or NON_RANDOM_METRICS)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start() \
        .awaitTermination()


def labelled_extremes(spark: SparkSession, out: str) -> DataFrame:
    """C2-C4 of all that has arrived: ``metric_name, best_or_worst, num, shard_stem, start_idx`` and a column per pattern."""
    state = _read(spark, f"{out}/state", epochs(spark, f"{out}/state")[-1:])
    labels = _read(spark, f"{out}/labels", epochs(spark, f"{out}/labels"))
    return state.join(labels, DOCUMENT).select(F.col("metric").alias("metric_name"), "best_or_worst",
                                               F.col("num").cast("int").alias("num"), *DOCUMENT, *PATTERN_FIELDS)
