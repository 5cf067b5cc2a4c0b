"""Pattern labelling of extreme documents.

The classifier is injected: any ``callable(text) -> dict[pattern name,
bool]``.  It runs inside ``mapInPandas`` with at most ``concurrency`` tasks
(one per partition after ``repartition``), retries a failing call up to
``max_retries`` times and then fails the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABEL_CONCURRENCY, LABEL_MAX_RETRIES, PATTERN_FIELDS, PATTERN_NAMES
from ..sources import files


def to_field(name: Column) -> Column:
    """Column name of a pattern name."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(words, "_")


def work_list(extremes: DataFrame, texts: DataFrame, done: DataFrame | None) -> DataFrame:
    """Best and worst per metric with their text, minus keys already
    labelled (anti join on ``(metric_name, best_or_worst, num)``)."""
    w = extremes.select(F.col("metric").alias("metric_name"), "best_or_worst", "num", "shard_stem", "start_idx") \
        .join(texts, ["shard_stem", "start_idx"])
    if done is not None:
        w = w.join(done.select("metric_name", "best_or_worst", "num"), ["metric_name", "best_or_worst", "num"],
                   "left_anti")
    return w


def classify(work: DataFrame, classifier: Callable[[str], dict], concurrency: int = LABEL_CONCURRENCY,
             max_retries: int = LABEL_MAX_RETRIES) -> DataFrame:
    """C2 + C4: one boolean column per pattern field."""
    keys = [c for c in work.columns if c != "text"]
    out_schema = T.StructType([f for f in work.schema.fields if f.name != "text"] +
                              [T.StructField(f, T.BooleanType()) for f in PATTERN_FIELDS] +
                              [T.StructField("text", T.StringType())])

    def call(text: str) -> dict:
        last = None
        for _ in range(max_retries):
            try:
                flags = classifier(text)
                if set(flags) != set(PATTERN_NAMES):
                    raise ValueError("classifier answer does not name every pattern")
                return flags
            except ValueError as exc:   # an invalid answer: ask again
                last = exc
        raise last

    def run(batches):
        for pdf in batches:
            rows = [call(t) for t in pdf["text"]]
            out = pdf[keys].copy()
            for name, field in zip(PATTERN_NAMES, PATTERN_FIELDS):
                out[field] = [bool(r[name]) for r in rows]
            out["text"] = pdf["text"].to_numpy()
            yield out

    return work.repartition(concurrency).mapInPandas(run, out_schema)


def rule_classifier(text: str) -> dict:
    """Fixed rule classifier used by tests and the registered query (the
    same rules are written in SQL for the oracle)."""
    upper = sum(1 for ch in text if "A" <= ch <= "Z")
    return {
        "Narrative Prose": len(text) > 1000,
        "Named-Entity Flood": upper * 10 > len(text),
        "SEO Spam": "http" in text,
        "OCR Noise": re.search(r"[0-9][a-z]", text) is not None,
        "Semantic Incoherence": len(text) < 200,
        "Word Salad": "." not in text,
        "Metadata Dump": "{" in text,
        "Mixed-Format": "<" in text,
        "Repetitive Templates": text.count("\n") > 10,
        "List-like Structure": re.search(r"\n[-*]", text) is not None,
    }


def append_new(labels: DataFrame, path: str, keys=("metric_name", "best_or_worst", "num")) -> int:
    """Append only rows whose key is not in the table at ``path``."""
    spark = labels.sparkSession
    new = labels
    if files.exists(spark, path):  # a table that cannot be read raises
        new = labels.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n
