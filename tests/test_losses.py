"""Bootstrap of all variants and look-ahead losses against plain loops."""

import math
from collections import Counter
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from shardwright.functions import stats
from shardwright.operators import evaluation as ev
from shardwright.operators import runs as rn


def mixed(x):
    x = (x ^ (x >> 15)) * rn.MIX[0] % 2 ** 32
    x = (x ^ (x >> 13)) * rn.MIX[1] % 2 ** 32
    return x ^ (x >> 16)


def test_hash_is_the_integer_one(spark):
    values = [0, 1, 2, 39_999, 2 ** 31, 2 ** 32 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", rn.mixed32(F.col("v")).alias("h")).collect()
    assert {r["v"]: r["h"] for r in rows} == {v: mixed(v) for v in values}
    draws = Counter(mixed(x) * 10 >> 32 for x in range(40_000))
    assert set(draws) == set(range(10)) and max(draws.values()) < 1.1 * min(draws.values())


def test_bootstrap_of_every_group(spark):
    runs = {"a": [3.0, 3.1, 3.25, 3.4], "b": [1.0 + k / 7 for k in range(11)]}
    frame = spark.createDataFrame([(g, k + 1, v) for g, vs in runs.items() for k, v in enumerate(vs)], "g string, o long, v double")
    got = {(r["g"], r["sample"]): r for r in rn.bootstrap_variants(frame, "g", "o", "v", 9, 6, 3.2, seed=2).collect()}
    assert len(got) == 18
    for (g, sample), r in got.items():
        drawn = [runs[g][mixed(2 * 54 + sample * 6 + j) * len(runs[g]) >> 32] for j in range(6)]
        assert r["n"] == 6 and r["mean"] == pytest.approx(mean(drawn))
        if len(set(drawn)) > 1:
            t = (mean(drawn) - 3.2) / (stdev(drawn) / math.sqrt(6))
            assert r["t"] == pytest.approx(t, abs=1e-9) and r["p"] == pytest.approx(stats.t_cdf(t, 5), abs=1e-9)


def test_lookahead(spark):
    lengths, weights = {"s": 5, "t": 1, "u": 2}, [1.0, 0.5, 0.25]
    rows = [(s, p, q, 10.0 * p + q) for s, n in lengths.items() for p in range(n) for q in range(p, n)]
    losses = spark.createDataFrame(rows, "seq string, pos long, target_pos long, loss double")
    got = {(r["seq"], r["pos"]): r["loss"] for r in ev.lookahead_loss(losses, weights, ["seq"]).collect()}
    assert got == {(s, p): sum(w * (10.0 * p + p + k) for k, w in enumerate(weights) if p + k < n)
                   for s, n in lengths.items() for p in range(n)}
    with pytest.raises(Exception, match="no loss of position 1 at target 2"):
        ev.lookahead_loss(losses.where("NOT (pos = 1 AND target_pos = 2)"), weights, ["seq"]).collect()
