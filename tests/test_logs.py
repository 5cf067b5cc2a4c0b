"""Text-log sources on literal lines."""

import pytest

from shardwright.operators import runs as rn
from shardwright.sources import logs

def lines(spark, rows):
    return spark.createDataFrame(rows, "run_id string, value string")


def test_run_log_lines(spark):
    df = lines(spark, [
        ("r", "import os  # the script prints its own source first"),
        ("r", "step:0/1490 val_loss:10.8258 train_time:0ms step_avg:0.04ms"),
        ("r", "step:1/1490 train_time:47ms step_avg:47.00ms"),
        ("r", "step:2/1490 train_loss:9.1234 train_time:90ms step_avg:45.00ms"),
        ("r", "step:250/1490 val_loss:4.1234 train_time:15000ms step_avg:60.00ms"),
        ("r", "garbage line"),
    ])
    p = logs.parse_run_log(df).orderBy("step").collect()
    assert [r.kind for r in p] == ["val", "train", "train", "val"]
    assert p[2].train_loss == 9.1234 and p[1].train_loss is None
    assert rn.final_val_loss(logs.parse_run_log(df)).first().final_val_loss == 4.1234


def test_loss_log_kinds(spark):
    df = lines(spark, [("exp1", "step,val_loss"), ("exp1", "200,4.1234"),
                       ("exp1", "shard,fineweb_train_000001.bin,3.9012"),
                       ("exp1", "last step 733, error x"), ("exp2", "200,4.5"),
                       ("exp2", "shard,fineweb_train_000001.bin,3.95")])
    v = logs.parse_loss_log(df)
    assert v["steps"].count() == 2
    assert v["ends"].first().step == 733
    piv = rn.loss_per_shard(v["shards"]).first()
    assert piv["exp1"] == 3.9012 and piv["exp2"] == 3.95
    bench = spark.createDataFrame([("exp1", 0.3, 3, 10), ("exp2", 0.4, 4, 10)], logs.BENCH_SCHEMA)
    cmp = {r.exp: r for r in rn.compare_experiments(v["steps"], bench).collect()}
    assert cmp["exp1"].loss_rank == 1 and cmp["exp2"].accuracy_rank == 1


def test_bench_log_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("random42_10", 0.35824, 3597, 10042)], logs.BENCH_SCHEMA)
    p = str(tmp_path / "bench")
    logs.format_bench_rows(df).write.text(p)
    back = logs.read_bench_log(spark, p).first()
    assert back.exp == "random42_10" and back.n_count == 10042 and abs(back.accuracy - 0.358) < 1e-9


def test_compact_log(spark):
    c = logs.parse_compact_log(lines(spark, [("m", "s:0 tel:10.9830"), ("m", "s:250 tel:6.3097"), ("m", "noise"),
                                             ("m", "s:500 tel:nan")])).orderBy("step").collect()
    assert [r.step for r in c] == [0, 250, 500] and c[1].val_loss == pytest.approx(6.3097) and c[2].val_loss != c[2].val_loss


def test_record_history(spark):
    table = ["# | Record time | Description | Date | Log | Contributors", "- | - | - | - | - | -",
             "1 | 45 minutes | [baseline](x) | 05/28/24 | [log](l) | @ann, [@bob](u)",
             "2 | 31.4 minutes | tuned rate | 06/06/24 | [log](l) | @ann",
             "| 3 | 0.5 hours | other | 10/04/24 | none | @cy and @bob |"]
    rec = logs.parse_record_table(lines(spark, [("r", v) for v in table]), "all")
    rows = rec.orderBy("num").collect()
    assert [r.minutes for r in rows] == [45.0, 31.4, 30.0] and rows[0].description == "baseline"
    assert rows[2].contributors == ["@cy", "@bob"] and str(rows[1].date) == "2024-06-06"
    speed = [r.speedup for r in rn.record_progression(rec).orderBy("num").collect()]
    assert speed[1] == pytest.approx(45 / 31.4) and speed[2] == pytest.approx(45 / 30)
    assert {tuple(r)[0]: tuple(r)[1] for r in rn.contributor_counts(rec).collect()} == {"@ann": 2, "@bob": 2, "@cy": 1}


def test_lines_of_many_runs_in_one_file(spark, tmp_path):
    """State crosses micro-batches; the number of files is that of the tasks, not of the runs."""
    from shardwright.streaming import run_follow

    def line(run, step, loss):
        return f"{run}\tstep:{step}/9 val_loss:{loss:.4f} train_time:{100 * step}ms step_avg:1.00ms"

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.txt").write_text("\n".join([line("r1", 1, 3.5), line("r2", 2, 3.2), "r2\tsome source line"]))
    (logs / "b.txt").write_text("\n".join([line("r1", 3, 3.1), line("r2", 1, 3.9), line("r1", 2, 3.2)]))
    out = run_follow.run_available(spark, str(logs), str(tmp_path / "c"), str(tmp_path / "o"), 3.28, run_pattern=None,
                                   files_per_trigger=1)
    got = {r["run_id"]: (r["final_step"], r["final_val_loss"], r["best_val_loss"], r["time_to_target_ms"], r["reached"])
           for r in out.collect()}
    assert got == {"r1": (3, 3.1, 3.1, 200.0, True), "r2": (2, 3.2, 3.2, 200.0, True)}
