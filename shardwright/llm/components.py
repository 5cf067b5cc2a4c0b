"""Connected components by alternating star contraction, all in Spark.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star the smaller ones; repeated, every component becomes a
star around its smallest id.  Each half of a round writes its edges to the
shared folder, so lineage stays short and the second half's plan does not hold
the first one's several times; only a count and a checksum of the edges reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("node", "low").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("low", "node"))
    smallest = both.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("m"))
    return both.join(smallest, "node").filter("low > node").select(F.col("low").alias("node"), F.col("m").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("node").agg(F.min("low").alias("m"))
    passed_on = edges.join(smallest, "node").filter("low <> m").select(F.col("low").alias("node"), F.col("m").alias("low"))
    return passed_on.union(smallest.select("node", F.col("m").alias("low")))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node, low``: every node that has a smaller id in its component, with the smallest one."""
    now = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low")).filter("node <> low").distinct()
    now = stage(now, "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            return now
        large = stage(_large_star(now).distinct(), "large")
        now = stage(_small_star(large).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
