"""The staged plan against a loader that goes call by call."""

import random

import pytest

from shardwright.operators.staged_packing import Schedule, Stage, first_calls, staged_plan


def plain_loader(shards, schedule):
    """Pieces of every call: one pointer, one call counter, shard after shard."""
    out, call = [], 0
    for shard_id, documents in shards:
        at = 0
        while True:
            stage = max(k for k, s in enumerate(schedule.stages) if s.first_step <= call // schedule.grad_accum)
            n, longest, idx, made = schedule.n_local(stage), schedule.stages[stage].max_seq_len, at, []
            for rank in range(schedule.world_size):
                held, piece = 0, 0
                while held <= n and idx < len(documents):
                    start, end = documents[idx]
                    end = min(end, start + longest, start + n - held + 1)
                    made.append((call // schedule.grad_accum, call % schedule.grad_accum, rank, stage, shard_id, f"s{shard_id}",
                                 piece, idx, start, end))
                    held, idx, piece = held + end - start, idx + 1, piece + 1
                if held <= n:
                    made = None
                    break
            if made is None:
                break
            out += made
            at, call = idx, call + 1
    return sorted(out)


def shards_of(rnd, n_shards, most):
    shards = []
    for k in range(n_shards):
        cuts = [0]
        for _ in range(rnd.randrange(most)):
            cuts.append(cuts[-1] + rnd.choice([1, 2, 5, 9, 30]))
        shards.append((3 * k + 1, list(zip(cuts, cuts[1:]))))
    return [s for s in shards if s[1]]


SCHEDULES = [
    Schedule((Stage(0, 16, 8), Stage(3, 32, 30), Stage(4, 8, 4), Stage(9, 64, 100)), 2, 2),
    Schedule((Stage(0, 40, 5), Stage(1, 8, 30), Stage(2, 24, 9)), 4, 1),
    Schedule((Stage(0, 12, 10),), 1, 3),
    Schedule((Stage(0, 8, 10), Stage(1000, 16, 10)), 2, 1),
    Schedule((Stage(0, 400, 10), Stage(1, 16, 10)), 2, 1),  # no shard holds a call of the first stage
]


@pytest.mark.parametrize("number", range(len(SCHEDULES)))
def test_as_the_loader(spark, number):
    rnd = random.Random(number)
    schedule, shards = SCHEDULES[number], shards_of(rnd, 12, 60)
    rows = [(s, f"s{s}", k, a, b) for s, docs in shards for k, (a, b) in enumerate(docs)]
    rnd.shuffle(rows)
    spans = spark.createDataFrame(rows, "shard_id int, shard_stem string, doc_idx long, start_idx long, end_idx long")
    wanted = plain_loader(shards, schedule)
    assert sorted(map(tuple, staged_plan(spans, schedule).collect())) == wanted
    entered = {r["shard_id"]: r["first_call"] for r in first_calls(spans, schedule).collect()}
    for shard, call in entered.items():
        earlier = [r for r in wanted if r[4] < shard]
        assert call == max((r[0] * schedule.grad_accum + r[1] + 1 for r in earlier), default=0)


def test_a_stage_ends_inside_a_shard():
    """Otherwise the queries above would prove little."""
    rnd = random.Random(0)
    rows = plain_loader(shards_of(rnd, 12, 60), SCHEDULES[0])
    assert any(len({r[3] for r in rows if r[4] == shard}) > 1 for shard in {r[4] for r in rows})


def test_no_spans(spark):
    empty = spark.createDataFrame([], "shard_id int, shard_stem string, doc_idx long, start_idx long, end_idx long")
    assert staged_plan(empty, SCHEDULES[0]).collect() == []


def test_bad_schedules_are_refused():
    with pytest.raises(ValueError, match="growing steps"):
        Schedule((Stage(1, 8, 8),), 1, 1)
    with pytest.raises(ValueError, match="do not divide"):
        Schedule((Stage(0, 9, 8),), 2, 1)
