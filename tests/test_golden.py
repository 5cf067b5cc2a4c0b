"""Golden values from the reference's own text (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from shardwright.functions import stats
from shardwright.operators import evaluation as ev
from shardwright.operators import packing as pk
from shardwright.operators import runs as rn
from shardwright.operators import schedule as sc
from shardwright.operators import spans as sp


def test_packing_example(spark):
    tasks = spark.createDataFrame([(0, 7, 0, 2, [2, 2, 1, 1], 2)],
                                  "rank int, task_id long, task_ord long, ctx_len int, end_lens array<int>, label int")
    spans = ev.ending_spans(ev.pack(tasks, 64)).orderBy("ending_id").collect()
    assert [(r.span_start, r.span_end) for r in spans] == [(1, 3), (5, 7), (9, 10), (12, 13)]
    ends = ev.doc_end_positions(ev.ending_spans(ev.pack(tasks, 64)), 64).first()
    # separators at inputs 3, 7, 10 -> document ends 4, 8, 11
    assert ends.doc_end_positions[:4] == [0, 4, 8, 11] and ends.doc_end_positions[4] == 64


def test_task_too_large_is_rejected(spark):
    tasks = spark.createDataFrame([(0, 1, 0, 40, [10, 10, 10, 10], 0)],
                                  "rank int, task_id long, task_ord long, ctx_len int, end_lens array<int>, label int")
    with pytest.raises(Exception):
        ev.pack(tasks, 64).collect()


def test_t_test_six_runs(spark):
    xs = [3.2756, 3.2786, 3.2773, 3.2791, 3.2778, 3.277]
    df = spark.createDataFrame([("a", x) for x in xs], "variant string, loss double")
    r = rn.decision_record(rn.one_sample_t(df, ["variant"], "loss", 3.28), 3.28).first()
    assert round(r.mean, 4) == 3.2776 and round(r.std, 4) == 0.0012
    assert r.t == pytest.approx(-4.792685, abs=1e-5)
    assert round(r.p, 4) == 0.0025


def test_welch_two_sided():
    base = [95.654, 95.622, 95.662, 95.639, 95.522]
    h1 = [95.572, 95.510, 95.589, 95.575, 95.639]
    h2 = [95.670, 95.744, 95.764, 95.722, 95.685]

    def welch_p(a, b):
        import statistics as st
        va, vb = st.variance(a) / len(a), st.variance(b) / len(b)
        t = (st.mean(a) - st.mean(b)) / math.sqrt(va + vb)
        df = (va + vb) ** 2 / (va * va / (len(a) - 1) + vb * vb / (len(b) - 1))
        return 2 * stats.t_cdf(-abs(t), df)

    assert round(welch_p(h1, base), 4) == 0.2285
    assert round(welch_p(h2, base), 4) == 0.0159


def test_welch_in_spark(spark):
    base = [95.654, 95.622, 95.662, 95.639, 95.522]
    h1 = [95.572, 95.510, 95.589, 95.575, 95.639]
    rows = [("base", i, 3.27, t) for i, t in enumerate(base)] + [("h1", i, 3.27, t) for i, t in enumerate(h1)]
    df = spark.createDataFrame(rows, "variant string, run int, loss double, time_s double")
    out = {r.variant: r for r in rn.with_p_values(rn.variant_vs_baseline(df, "base", 3.28)).collect()}
    assert round(out["h1"].p_time, 4) == 0.2285
    assert out["base"].p_time is None


def test_interval_99():
    mean, std, n = 2.919815, 0.000751, 80
    t99 = stats.t_ppf(0.995, n - 1)
    se = std / math.sqrt(n)
    # inputs are published rounded to 6 digits, so the bounds agree to about 1e-6
    assert mean - t99 * se == pytest.approx(2.919594, abs=2e-6)
    assert mean + t99 * se == pytest.approx(2.920037, abs=2e-6)
    p = stats.t_cdf((mean - 2.92) / se, n - 1)
    assert p == pytest.approx(0.015461, abs=1e-3)


def test_stage_bounds(spark):
    b = sc.stage_bounds(sc.stage_table(spark)).orderBy("idx").collect()
    assert [(r.start_step, r.end_step) for r in b] == [(0, 483), (483, 967), (967, 1450), (1450, 10000)]
    split = [r for r in b if r.idx == 2][0].start_step | 1
    assert split == 967
    lr = spark.range(1).select(sc.learning_rate(F.lit(580), F.lit(1.0)).alias("a"),
                               sc.learning_rate(F.lit(579), F.lit(1.0)).alias("b")).first()
    assert lr.a == 1.0 and lr.b == 1.0


def test_bigram_hash(spark):
    r = spark.range(1).select(pk.bigram_hash(F.array(F.lit(40000), F.lit(50256))).alias("h")).first()
    assert r.h == [251519, 188939]


def test_block_document_ranges(spark):
    runs = spark.createDataFrame([(0, 1, 0, 3), (0, 2, 3, 8), (0, 3, 8, 11), (0, 4, 11, 12)],
                                 "s int, doc_id long, run_start long, run_end long")
    b = sp.block_doc_ranges(runs, ["s"], 2).orderBy("blk").collect()
    assert [r.doc_low for r in b] == [1, 1, 2, 2, 3, 3]
    assert [r.doc_high for r in b] == [1, 2, 2, 2, 3, 4]


def test_retiming(spark):
    row = spark.createDataFrame([(104.9, 104.062, 98.43)], "official double, prior double, new double")
    assert round(row.select(rn.retime(F.col("official"), F.col("prior"), F.col("new"))).first()[0], 1) == 99.3
