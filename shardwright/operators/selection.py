"""Data selection over per-document metrics.

Input: a metrics table ``(shard_stem, start_idx, end_idx, has_enough_tokens,
<metric columns>)``.  Orders are total (ties broken by shard and position)
and global ranks come from the distributed row number of ``ordering``,
never from an un-partitioned window.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import METRIC_COLUMNS, PREVIEW_CHARS, SELECTION_DIVISOR, SELECTION_FILES
from .ordering import global_row_number


def keep_enough_tokens(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``has_enough_tokens`` and a one-row drop report."""
    report = metrics.agg(
        F.count(F.lit(1)).cast("long").alias("n_total"),
        F.count_if(F.col("has_enough_tokens")).cast("long").alias("n_kept"),
        F.count_if(~F.col("has_enough_tokens")).cast("long").alias("n_dropped"))
    return metrics.where(F.col("has_enough_tokens")), report


def input_order(metrics: DataFrame) -> DataFrame:
    """Input order of the reference (files sorted by name, rows in file order)."""
    return global_row_number(metrics, [F.col("shard_stem").asc(), F.col("start_idx").asc()], "input_ord")


def trim_to_multiple(ordered: DataFrame, divisor: int = SELECTION_DIVISOR) -> DataFrame:
    """Keep the first ``(n div divisor) * divisor`` rows in input order."""
    n = ordered.count()
    n_keep = (n // divisor) * divisor
    return ordered.where(F.col("input_ord") <= F.lit(n_keep))


def long_form(metrics: DataFrame, metric_cols: list[str] | None = None) -> DataFrame:
    """Stack the metric columns: ``(metric, value)`` per row."""
    cols = list(metric_cols or METRIC_COLUMNS)
    keys = [c for c in metrics.columns if c not in cols]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                  for c in cols]))
    return metrics.select(*keys, stacked.alias("__m")).select(*keys, "__m.metric", "__m.value")


def descending_order(value: str = "value") -> list[Column]:
    """Highest first, NaN last (Spark alone would put NaN first), ties by
    shard and position."""
    return [F.isnan(F.col(value)).asc(), F.col(value).desc(), F.col("shard_stem").asc(), F.col("start_idx").asc()]


def rank_per_metric(long_df: DataFrame) -> DataFrame:
    """Rank of every row inside its metric (distributed row number)."""
    return global_row_number(long_df, descending_order(), "rank", partition_cols=["metric"])


def split_files(ranked: DataFrame, n_rows: int, n_files: int = SELECTION_FILES) -> DataFrame:
    """Ten equal files per metric, file 1 holds the highest values."""
    per_file = n_rows // n_files
    return ranked.withColumn("file_no", (F.floor((F.col("rank") - 1) / F.lit(per_file)) + 1).cast("int")) \
        .where(F.col("file_no") <= n_files)


def file_sums(chunks: DataFrame) -> DataFrame:
    """``(shard_stem, n_tokens, token_sum, weighted_sum)`` of files read as ``(shard_stem, start_pos, tokens)`` rows.

    ``weighted_sum`` (id times position) grows with the square of a file's length and passes
    64 bits at some 400 million byte tokens.  It is summed exactly and given as its lowest 64
    bits, as a signed number: the sum itself as long as that is a long, a checksum beyond.
    """
    zero = F.lit(0).cast("long")
    # a row's own sum is a long: at most 65,536 ids, below 2**16, at positions below 2**31 (the header's count)
    weighted = F.aggregate(F.transform("tokens", lambda x, i: x.cast("long") * (F.col("start_pos") + i)), zero, lambda a, x: a + x)
    rows = chunks.select("shard_stem", F.size("tokens").alias("n"), F.aggregate("tokens", zero, lambda a, x: a + x).alias("s"),
                         weighted.cast("decimal(20,0)").alias("w"))
    half, whole = F.lit(Decimal(2 ** 63)), F.lit(Decimal(2 ** 64))
    return rows.groupBy("shard_stem").agg(
        F.sum("n").cast("long").alias("n_tokens"), F.sum("s").cast("long").alias("token_sum"),
        (F.pmod(F.sum("w") + half, whole) - half).cast("long").alias("weighted_sum"))


def extremes(long_df: DataFrame, n: int, nan: str = "drop") -> DataFrame:
    """Top ``n`` (highest first) and bottom ``n`` (lowest first) per metric.

    ``nan="drop"`` leaves NaN out; ``nan="best"`` reproduces the reference's
    ascending sort where NaN sorts last and so lands among the best.
    Row-number filters per metric are planned with a window group limit, so
    each task ships at most ``n`` rows per metric before the exchange.
    """
    df = long_df.where(~F.isnan("value")) if nan == "drop" else long_df
    isn = F.isnan(F.col("value"))
    best_w = Window.partitionBy("metric").orderBy(
        isn.desc(), F.col("value").desc(), F.col("shard_stem").desc(), F.col("start_idx").desc())
    worst_w = Window.partitionBy("metric").orderBy(
        isn.asc(), F.col("value").asc(), F.col("shard_stem").asc(), F.col("start_idx").asc())
    best = df.withColumn("num", F.row_number().over(best_w)).where(F.col("num") <= n) \
        .withColumn("best_or_worst", F.lit("best"))
    worst = df.withColumn("num", F.row_number().over(worst_w)).where(F.col("num") <= n) \
        .withColumn("best_or_worst", F.lit("worst"))
    return best.unionByName(worst)


def preview(text: Column, n_chars: int = PREVIEW_CHARS) -> Column:
    """First ``n_chars`` characters, an ellipsis when cut."""
    return F.when(F.length(text) > n_chars, F.concat(F.substring(text, 1, n_chars), F.lit("…"))) \
        .otherwise(text)


def report_line() -> Column:
    """One line of the extremes report: rank, value, shard and the span it holds."""
    return F.format_string("%d. %.4f %s [%d,%d)", "num", "value", "shard_stem", "start_idx", "end_idx")


def random_subset(scored: DataFrame, score_col: str, percent: float) -> DataFrame:
    """Rows whose seeded uniform score is below ``percent / 100``; the
    subsets of one seed are nested (10 within 30 within 50 within 70)."""
    return scored.where(F.col(score_col) < F.lit(percent / 100.0))


def uniform_score(seed: int, *key: Column) -> Column:
    """Seeded uniform score in [0, 1) from a hash of the row key.

    Deterministic for a seed whatever the partitioning (``rand(seed)`` is not).
    """
    h = F.xxhash64(F.lit(seed), *key)
    return (F.pmod(h, F.lit(1 << 53).cast("long")).cast("double") / float(1 << 53))
