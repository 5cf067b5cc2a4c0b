"""Global order without a single-partition window.

The reference's rules are sequential (running token offsets, trimming in
input order, ranks after a sort).  An un-partitioned window would put the
whole table in one task, so two distributed patterns are used instead:

* ``prefix_sum``: prefix sum over an ordinal column in three levels.  Rows are
  grouped in deterministic blocks (``ordinal div block_size``), blocks in
  groups of ``block_size`` blocks; only the groups' totals are ordered as a
  whole.  Block size bounds every other window partition.
* ``global_row_number``: ordinal under an arbitrary total order.  Spark's
  range-partitioned sort splits even a hot tied value (the order is made
  unique with tie-breaker columns), the sorted frame is checkpointed so the
  partitioning is fixed, and each partition adds the row count of the
  partitions before it (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Largest side (rows) ever broadcast by these helpers.  Block and partition
# tables are tiny; the check exists so a misuse cannot broadcast a big table.
BROADCAST_MAX_ROWS = 2_000_000


def _bounded_broadcast(small: DataFrame, n_rows_bound: int) -> DataFrame:
    return F.broadcast(small) if n_rows_bound <= BROADCAST_MAX_ROWS else small


def _bases(totals: DataFrame, parts: list[str], block_size: int) -> DataFrame:
    """``__blk_base`` of every block: the totals of the blocks before it.

    Blocks are summed in groups of ``block_size`` again, so that the one table
    that is ordered as a whole has a row per ``block_size ** 2`` ordinals, and
    sparse ordinals, which leave one row to a block, do not meet in one task.
    """
    grouped = totals.withColumn("__top", F.floor(F.col("__blk") / F.lit(block_size)).cast("long"))
    tops = grouped.groupBy(*parts, "__top").agg(F.sum("__blk_total").alias("__top_total"))
    before = Window.unboundedPreceding, -1
    all_tops = Window.partitionBy(*parts).orderBy("__top").rowsBetween(*before)
    tops = tops.select(*parts, "__top", F.coalesce(F.sum("__top_total").over(all_tops), F.lit(0)).alias("__top_base"))
    in_top = Window.partitionBy(*parts, "__top").orderBy("__blk").rowsBetween(*before)
    local = F.coalesce(F.sum("__blk_total").over(in_top), F.lit(0))
    return grouped.withColumn("__local", local).join(tops, [*parts, "__top"]).select(
        *parts, "__blk", (F.col("__top_base") + F.col("__local")).alias("__blk_base"))


def prefix_sum(df: DataFrame, ordinal: str, value: str, out: str,
               partition_cols: list[str] | None = None, block_size: int = 4096,
               inclusive: bool = False, out_type: str | None = "long") -> DataFrame:
    """Exclusive (default) running sum of ``value`` in ``ordinal`` order.

    ``ordinal`` must be unique inside ``partition_cols``.  The block table has
    about ``n / block_size`` rows; its join is broadcast by adaptive execution
    when its measured size allows, else shuffled.
    """
    parts = list(partition_cols or [])
    blk = "__blk"
    with_blk = df.withColumn(blk, F.floor(F.col(ordinal) / F.lit(block_size)).cast("long"))
    totals = with_blk.groupBy(*parts, blk).agg(F.sum(value).alias("__blk_total"))
    bases = _bases(totals, parts, block_size)
    # The block table has one row per ``block_size`` rows of input.  No
    # driver-side bound is taken (that would be a second pass over the
    # input): adaptive execution measures the materialised block table and
    # broadcasts it only when it is under the broadcast threshold, otherwise
    # the join stays a shuffle join.
    joined = with_blk.join(bases, on=parts + [blk], how="inner")
    w_in = Window.partitionBy(*parts, blk).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(value).over(w_in)
    if not inclusive:
        run = run - F.col(value)
    total = F.col("__blk_base") + run
    return joined.withColumn(out, total.cast(out_type) if out_type else total).drop(blk, "__blk_base")


def global_row_number(df: DataFrame, order: list[Column], out: str,
                      partition_cols: list[str] | None = None) -> DataFrame:
    """1-based row number under ``order`` (restarting per ``partition_cols``).

    ``order`` must be a total order (end it with unique tie-breakers), so the
    result is deterministic.  No window ever holds more than one partition of
    the range-partitioned sort.
    """
    parts = list(partition_cols or [])
    mid = "__mid"
    sort_cols = [F.col(p).asc() for p in parts] + list(order)
    sorted_df = df.orderBy(*sort_cols).withColumn(mid, F.monotonically_increasing_id())
    # Fix partitioning and ids: counts and ids must come from the same run.
    sorted_df = cut_lineage(sorted_df)
    pid = (F.col(mid) / F.lit(1 << 33)).cast("long")
    local = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    with_pid = sorted_df.withColumn("__pid", pid).withColumn("__local", local)
    counts = with_pid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0)
    bases = counts.select("__pid", (F.sum("__n").over(w) - F.col("__n")).alias("__base"))
    n_parts = sorted_df.rdd.getNumPartitions()
    ranked = with_pid.join(_bounded_broadcast(bases, n_parts), "__pid").withColumn(
        "__g", F.col("__base") + F.col("__local") + 1)
    if parts:
        # rows of one partition key are contiguous in the global order
        firsts = ranked.groupBy(*parts).agg(F.min("__g").alias("__first"))
        n_keys = firsts.count()
        ranked = ranked.join(_bounded_broadcast(firsts, n_keys), parts).withColumn(
            out, F.col("__g") - F.col("__first") + 1).drop("__first")
    else:
        ranked = ranked.withColumn(out, F.col("__g"))
    return ranked.drop(mid, "__pid", "__local", "__base", "__g")
