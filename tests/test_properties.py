"""Invariants of the sequential rules and scale invariance."""

from pyspark.sql import functions as F

from shardwright.operators import labels as lb
from shardwright.operators import packing as pk
from shardwright.operators import tokens as tk
from shardwright.operators.ordering import prefix_sum
from shardwright.plans import corpus


def test_slices_hold_n_plus_one(spark, small_dir):
    _, _, spans = corpus.index(spark, small_dir)
    plan = pk.batch_plan(spans, 4096, 512, 2, 1)
    per = plan.groupBy("step", "rank").agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("n"),
                                           F.max(F.col("end_idx") - F.col("start_idx")).alias("m"))
    assert per.where(F.col("n") != 2049).count() == 0
    assert per.where(F.col("m") > 512).count() == 0
    # every document is used at most once
    assert plan.groupBy("shard_id", "doc_idx").count().where("count > 1").count() == 0


def test_plan_independent_of_partitioning(spark, small_dir):
    _, _, spans = corpus.index(spark, small_dir)
    a = pk.batch_plan(spans.repartition(1), 4096, 512, 2, 1).collect()
    b = pk.batch_plan(spans.repartition(7, "doc_idx"), 4096, 512, 2, 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_empty_text_is_delimiter_only(spark):
    c = spark.createDataFrame([(0, ""), (1, "ab")], "doc_ord long, text string")
    rows = {r.doc_ord: r.tokens for r in tk.tokenize(c).collect()}
    assert rows[0] == [50256] and rows[1] == [50256, 97, 98]


def test_shards_partition_the_stream(spark):
    c = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([9, 0, 25, 3])], "doc_ord long, text string")
    pieces = tk.shard_pieces(tk.corpus_offsets(c), 10).collect()
    per = {}
    for p in pieces:
        per[p.shard_id] = per.get(p.shard_id, 0) + p.piece_len
    assert per == {0: 10, 1: 10, 2: 10, 3: 10, 4: 1}
    # a document longer than a shard spans three shards
    assert sorted(p.shard_id for p in pieces if p.doc_ord == 2) == [1, 2, 3]


def test_pattern_fields(spark):
    names = spark.createDataFrame([(n,) for n in lb.PATTERN_NAMES], "name string")
    assert [r[0] for r in names.select(lb.to_field(F.col("name"))).collect()] == lb.PATTERN_FIELDS


def test_classifier_retries_then_fails(spark):
    calls = {"n": 0}

    def flaky(text):
        calls["n"] += 1
        raise ValueError("bad answer")

    w = spark.createDataFrame([("m", "best", 1, "text")], "metric_name string, best_or_worst string, num int, text string")
    try:
        lb.classify(w, flaky, concurrency=1).collect()
        raised = False
    except Exception:
        raised = True
    assert raised


def test_prefix_sum_of_sparse_ordinals(spark):
    rows = [(k * 1_000_003 % (1 << 40), k + 1) for k in range(500)]
    out = prefix_sum(spark.createDataFrame(rows, "o long, v long"), "o", "v", "before", block_size=64).collect()
    total, want = 0, {}
    for o, v in sorted(rows):
        want[o] = total
        total += v
    assert {r["o"]: r["before"] for r in out} == want
