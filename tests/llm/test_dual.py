"""The dual of the mix converges on heavy-tailed sources, or says that it has not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.llm import mixing


def test_heavy_tailed_sources_converge_or_raise(spark):
    rnd = np.random.default_rng(5)
    cells = {(f"s{k:03}", int(1 + rnd.pareto(0.6) * 20)) for k in range(200) for _ in range(rnd.integers(1, 30))}
    cells = [(s, z, int(rnd.integers(1, 50))) for s, z in sorted(cells)]
    frame = spark.createDataFrame(cells, "source string, size long, n long")
    targets = mixing.source_targets(frame).withColumn("n_docs", F.lit(0))
    with pytest.raises(RuntimeError, match="has not converged"):
        mixing.newton(frame, targets, 3.0, 0.5, most_jobs=1, steps_a_job=1)
    lam = {r["source"]: r["lam"] for r in mixing.newton(frame, targets, 3.0, 0.5).collect()}
    for t in targets.collect():
        if t["source"] in lam:
            mine = [(z, n) for s, z, n in cells if s == t["source"]]
            got = sum(n * z * 3 / (1 + 2 * np.exp(-lam[t["source"]] * (z / t["mean_size"]) ** 0.5)) for z, n in mine)
            assert abs(got / t["target"] - 1) < 1e-5, t
