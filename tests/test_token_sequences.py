"""Token sequences of multiple-choice tasks against appending them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from shardwright.operators import evaluation as ev

DELIMITER = 50256


def plain(tasks, seq_len):
    """(inputs, targets) of every sequence of one rank."""
    out, inputs, targets = [], [], []

    def flush():
        pad = [0] * (seq_len - len(inputs))
        out.append((inputs + pad, targets + pad))

    for ctx, endings in tasks:
        ids = [(list(ctx.encode()), list((" " + e).encode())) for e in endings]
        if len(inputs) + sum(len(c) + len(e) for c, e in ids) >= seq_len:
            flush()
            inputs, targets = [], []
        for c, e in ids:
            if inputs:
                inputs.append(DELIMITER)
                targets.append(DELIMITER)
            inputs += (c + e)[:-1]
            targets += (c + e)[1:]
    flush()
    return out


def task_rows(n):
    rnd = random.Random(9)
    return [(k, "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(1, 12))),
             ["".join(rnd.choice("xyz😀") for _ in range(rnd.randrange(1, 9))) for _ in range(4)], k % 4) for k in range(n)]


@pytest.mark.parametrize("seq_len", [200, 333])
def test_sequences(spark, seq_len):
    rows = task_rows(40)
    tasks = spark.createDataFrame(rows, "task_id long, ctx string, endings array<string>, label int")
    placed = tasks.withColumn("rank", (F.col("task_id") % 3).cast("int")).withColumn("task_ord", F.floor(F.col("task_id") / 3).cast("long"))
    packed = ev.pack(ev.token_counts(placed), seq_len)
    got = {(r["rank"], r["seq_no"]): (list(r["inputs"]), list(r["targets"])) for r in ev.token_sequences(packed, seq_len).collect()}
    wanted = {(rank, k): s for rank in range(3) for k, s in enumerate(plain([r[1:3] for r in rows[rank::3]], seq_len))}
    assert got == wanted
    for r in ev.ending_spans(packed).collect():  # a span's targets are the ending
        targets = got[r["rank"], r["seq_no"]][1][r["span_start"]:r["span_end"]]
        assert bytes(targets).decode() == " " + rows[r["task_id"]][2][r["ending_id"]]
    for r in ev.doc_end_positions(ev.ending_spans(packed), seq_len).collect():
        inputs = got[r["rank"], r["seq_no"]][0]
        assert list(r["doc_end_positions"])[1:r["n_separators"] + 1] == [k + 1 for k, t in enumerate(inputs) if t == DELIMITER]
    with pytest.raises(Exception, match="does not follow"):
        ev.token_sequences(packed, seq_len, lambda t: [1, 2, 3, 4, 5]).collect()
