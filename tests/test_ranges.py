"""Bucketed interval join against a brute-force overlap check."""

import random

from shardwright.operators.ranges import overlap_join


def test_overlap_join_matches_brute_force(spark):
    rnd = random.Random(7)
    left = [(k, i, s, s + rnd.randint(1, 40)) for i in range(60) for k in (0, 1) for s in [rnd.randint(0, 300)]]
    right = [(k, j, s, s + rnd.randint(1, 90)) for j in range(80) for k in (0, 1) for s in [rnd.randint(0, 300)]]
    L = spark.createDataFrame(left, "k int, li int, a long, b long")
    R = spark.createDataFrame(right, "k int, rj int, c long, d long")
    got = sorted((r.k, r.li, r.rj) for r in overlap_join(L, R, ["k"], ("a", "b"), ("c", "d"), width=16).collect())
    want = sorted((k, i, j) for (k, i, a, b) in left for (k2, j, c, d) in right if k == k2 and a < d and c < b)
    assert got == want


def test_plan_same_without_adaptive_execution(spark, small_dir):
    import __spark_entry__ as ent
    q = ent.queries()["d9_block_ranges"]
    a = sorted(map(tuple, q(spark, small_dir).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = sorted(map(tuple, q(spark, small_dir).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert a == b
