"""Interval joins expressed as equi-joins.

Spark plans a join whose only condition is an interval overlap as a
nested loop (or as an equi-join on a coarse key followed by a quadratic
filter inside that key).  Here both sides explode the ids of the fixed-width
buckets they touch and join on ``(keys, bucket)``; a pair is kept only in the
bucket holding the larger of the two starts, so each overlapping pair comes
out exactly once.  Work per bucket is bounded by what overlaps the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str],
                 left_range: tuple[str, str], right_range: tuple[str, str],
                 width: int) -> DataFrame:
    """Inner join of half-open ranges ``[lo, hi)`` that overlap, per ``keys``.

    Column names of the two sides must be distinct apart from ``keys``.
    ``width`` should be about the typical range length: a range of length L
    is copied into ``L/width + 2`` buckets at most.
    """
    W = F.lit(int(width)).cast("long")
    llo, lhi = left_range
    rlo, rhi = right_range

    def buckets(df, lo, hi):
        return df.where(F.col(hi) > F.col(lo)).withColumn(
            "__bkt", F.explode(F.sequence(F.floor(F.col(lo) / W), F.floor((F.col(hi) - 1) / W))))

    lb = buckets(left, llo, lhi)
    rb = buckets(right, rlo, rhi)
    j = lb.join(rb, keys + ["__bkt"])
    start = F.greatest(F.col(llo), F.col(rlo))
    cond = (F.col(llo) < F.col(rhi)) & (F.col(rlo) < F.col(lhi)) & \
        (F.floor(start / W) == F.col("__bkt"))
    return j.where(cond).drop("__bkt")
