"""Exact dedup by a tree merge of digest runs (DataFrame operations only).

Rows are dealt to ``fan_in ** rounds`` runs by a hash of their id.  Inside a
run, equal texts are merged to one entry (digest, smallest id, count).  In
every round ``fan_in`` neighbouring runs meet in one: the sort-merge aggregate
combines their sorted entries and keeps the smallest identifier of each
digest, until a single run, spread over all tasks by digest, is left.  The
result then walks down the same tree: an entry only ever joins the at most
``fan_in`` entries below it, and a row joins the entry of its own run, so a
text that a third of all rows share is spread over all the runs and no task
receives it whole.  Every level is written once, so that the way down does not
plan the way up again for each level.

Two texts share an entry only if SHA-256, length in bytes and a second,
independent 64-bit hash of the normalised text all agree at every level.

Nulls: a null text counts as empty; a null id sorts after all others and its
row can be kept only if the whole group has no id.  Repeated rows (same id,
same text) count separately, and exactly one of them is kept.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

WHITE_SPACE = r"[\x20\x09-\x0D]+"
DIGEST = ["sha", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digest_table(docs: DataFrame, id_col: str, text_col: str, n_runs: int, row: Column) -> DataFrame:
    """One row per document: id, row number, run, digest of the normalised text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"),
                        row.alias("rid"))
    rows = texts.select(
        "id", "rid", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"))
    return rows.withColumn("run", F.pmod(F.xxhash64("id", "rid"), F.lit(n_runs)))


def _merge(entries: DataFrame, run: Column) -> DataFrame:
    """Sort-merge entries of the runs that ``run`` brings together."""
    return entries.groupBy(run.alias("run"), *DIGEST).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = 8, rounds: int = 3, row_col: str | None = None) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` (and the row number ``row_col``): one row per input row."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = stage(digest_table(docs, id_col, text_col, fan_in ** rounds, row), "digests")
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    entries = rows.select("run", *DIGEST, first.alias("first"), F.lit(1).cast("long").alias("n"))
    levels = [stage(_merge(entries, F.col("run")), "runs")]
    for _ in range(rounds):
        levels.append(stage(_merge(levels[-1], F.floor(F.col("run") / fan_in)), "runs"))
    # the top run holds the answer of every digest; hand it down level by level
    answer = levels[-1].select(*DIGEST, F.col("run").alias("up"), F.col("first").alias("best"), F.col("n").alias("size"))
    for level in levels[-2::-1]:
        below = level.select("run", *DIGEST, F.floor(F.col("run") / fan_in).alias("up"))
        answer = below.join(answer, ["up", *DIGEST]).select(
            *DIGEST, F.col("run").alias("up"), "best", "size")
    out = rows.withColumnRenamed("run", "up").join(answer, ["up", *DIGEST])
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
        *([F.col("rid").alias(row_col)] if row_col else []))
