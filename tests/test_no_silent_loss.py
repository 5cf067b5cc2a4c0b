"""What must not be lost, altered or accepted without a word."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.constants import METRIC_COLUMNS
from shardwright.functions import encoders, stats
from shardwright.operators import evaluation as ev
from shardwright.operators import geometry as geo
from shardwright.operators import packing as pk
from shardwright.operators import runs as rn
from shardwright.operators import spans as sp
from shardwright.plans import q_selection
from shardwright.sources import logs
from shardwright.sources import metrics as mx
from shardwright.sources import token_bin as tb


def test_metrics_of_a_shard_stay_together_whatever_the_file_limit(spark, tmp_path):
    cols = {c: F.col("id") * 1.0 for c in METRIC_COLUMNS}
    rows = spark.range(60).select(F.format_string("fineweb_train_%d", F.col("id") % 2).alias("shard_stem"), F.lit(True).alias(
        "has_enough_tokens"), F.col("id").alias("start_idx"), (F.col("id") + 1).alias("end_idx"), *[c.alias(n) for n, c in cols.items()])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        assert mx.write_metrics(rows, str(tmp_path / "m")) == ["fineweb_train_0", "fineweb_train_1"]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert mx.read_metrics(spark, str(tmp_path / "m")).count() == 60
    assert mx.write_metrics(rows, str(tmp_path / "m")) == []  # done shards are skipped


def test_extremes_are_taken_before_the_trim(spark, small_dir):
    kept = q_selection.metrics_standin(spark, small_dir).where("has_enough_tokens")
    best = q_selection.extremes_query(spark, small_dir, 1).where("metric = 'schatten_norm' AND best_or_worst = 'best'").first()
    assert best["value"] == kept.agg(F.max("schatten_norm")).first()[0]


def test_a_diverged_run_ends_with_nan(spark):
    lines = spark.createDataFrame([("r", "step:0/20 val_loss:10.8 train_time:0ms step_avg:nanms"),
                                   ("r", "step:10/20 val_loss:nan train_time:9ms step_avg:0.90ms"),
                                   ("r", "step:5/20 train_loss:inf train_time:9ms step_avg:0.90ms")], "run_id string, value string")
    parsed = logs.parse_run_log(lines)
    assert parsed.count() == 3
    last = rn.final_val_loss(parsed).first()
    assert last["final_step"] == 10 and math.isnan(last["final_val_loss"])


def test_cyclic_loader_with_any_shard_id(spark):
    sizes = spark.createDataFrame([(1, "a", 400), (1_000_005, "b", 400)], "shard_id long, shard_stem string, shard_len long")
    rows = pk.cyclic_loader(sizes, 2, 10, 2, 2).where("rank = 0").orderBy("batch_no").collect()
    assert [r["batch_no"] for r in rows] == list(range(len(rows)))
    assert [r["epoch"] for r in rows] == sorted(r["epoch"] for r in rows)
    with pytest.raises(Exception, match="less than"):
        pk.cyclic_loader(sizes.withColumn("shard_len", F.lit(39).cast("long")), 2, 10, 2, 1).collect()


def test_a_partial_batch_is_refused(spark):
    loss = spark.range(40).select(F.col("id").alias("pos"), F.lit(1.0).alias("loss"))
    assert ev.validation_loss(loss.where("pos < 32"), 16, 4).first()["n_batches"] == 2
    with pytest.raises(Exception, match="batch holds less"):
        ev.validation_loss(loss, 16, 4).collect()


def test_too_many_separators_are_refused(spark):
    spans = spark.range(1, 300).select(F.lit(0).alias("rank"), F.lit(0).alias("seq_no"), F.col("id").alias("piece_start"))
    with pytest.raises(Exception, match="separators"):
        ev.doc_end_positions(spans, 4096).collect()


def test_quantiles_far_out():
    assert stats.t_ppf(0.9999, 1) == pytest.approx(math.tan(math.pi * 0.4999), rel=1e-6)
    assert stats.chi2_ppf(0.5, 1e6) == pytest.approx(999_999.3333, abs=0.01)
    assert stats.t_cdf(2.0, 1e6) == pytest.approx(0.977249, abs=1e-6)
    assert stats.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)  # 1 - (0.6**4 + 4 * 0.4 * 0.6**3)
    assert stats.gammainc(1.0, 2.0) == pytest.approx(1 - math.exp(-2))


def test_other_chunk_sizes(spark):
    chunks = spark.createDataFrame([("s", k, 16 * k, [65 + k] * 16) for k in range(7)],
                                   "shard_stem string, chunk_id int, start_pos long, tokens array<int>")
    spans = spark.createDataFrame([("s", 0, 100)], "shard_stem string, start_idx long, end_idx long")
    text = sp.decode_spans(spans, chunks, chunk_size=16).first()["text"]
    assert text == "".join(chr(65 + k) * 16 for k in range(7))[1:100]
    with pytest.raises(Exception, match="chunks are not"):
        sp.decode_spans(spans, chunks).collect()


def test_ids_that_are_no_bytes_give_no_text(spark):
    rows = spark.createDataFrame([(0, [72, 105]), (1, [72, 50256, 300]), (2, []), (3, [33])], "k int, tokens array<int>")
    assert [r["text"] for r in encoders.byte_decode_frame(rows).orderBy("k").collect()] == ["Hi", None, "", "!"]


def test_overwrite_replaces_the_shards(spark, tmp_path):
    def shards(*stems):
        return spark.createDataFrame([(s, 0, [1, 2, 3]) for s in stems], "shard_stem string, start_pos long, tokens array<int>")

    folder = str(tmp_path / "bin")
    tb.write_shards(shards("s1", "s2"), folder)
    shards("s3").coalesce(1).write.format("token_bin").mode("overwrite").option("path", folder).save()
    assert [r["shard_stem"] for r in tb.header_inventory(spark, folder + "/*.bin").collect()] == ["s3"]


def test_geometry_invariants():
    rnd = np.random.default_rng(0)
    stack = rnd.standard_normal((5, 60, 12))
    stack[1, :, 3:] = 0.0  # of rank 3
    m = geo.stacked_metrics(stack, 12)
    frobenius = np.sqrt((stack ** 2).sum(axis=(1, 2)))
    assert ((m["effective_rank"] >= 1) & (m["effective_rank"] <= 12 + 1e-6)).all() and m["effective_rank"][1] <= 3 + 1e-6
    assert (m["schatten_norm"] >= frobenius - 1e-9).all()
    assert np.allclose(m["sq_singular"], frobenius ** 2) and np.allclose(m["proj_sq_norm"], frobenius ** 2)
    assert (geo.stacked_metrics(stack, 4)["proj_sq_norm"] <= frobenius ** 2 + 1e-9).all()
    assert m["MLE"][1] < m["MLE"][0] and m["TwoNN"][1] < m["TwoNN"][0] and m["CorrInt"][1] < m["CorrInt"][0]
    small = geo.stacked_metrics(stack[:, :2])
    assert np.isnan(small["TwoNN"]).all() and np.isnan(small["CorrInt"]).all()
