"""Aligned batch plan whose slice size and longest document follow the stage of the global step.

The loader's state between two shards is one number, the calls made so far: it says
which stage holds, and a shard is always entered at its first delimiter.  So every
shard is a function from the call number it is entered with to the one it is left with.
Within a stage that function adds the shard's call count under the stage's settings,
and prefix sums over all shards, one per stage, compose it for every shard at once.  Only
a shard in which a stage ends is different: it is followed call by call from the
number it is entered with.  There is at most one such shard per boundary, found by its
prefix sum; what comes after starts from the number it is left with.

The functions per shard read span rows only (a shard has a fixed token budget); the
rows that carry a stage's start are one per boundary and stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import prefix_sum


@dataclass(frozen=True)
class Stage:
    """Settings from a step on; the last stage has no end."""

    first_step: int
    num_tokens: int  # per step, over all ranks and micro-steps
    max_seq_len: int


@dataclass(frozen=True)
class Schedule:
    stages: tuple[Stage, ...]
    world_size: int
    grad_accum: int

    def __post_init__(self):
        firsts = [s.first_step for s in self.stages]
        if firsts[:1] != [0] or firsts != sorted(set(firsts)):
            raise ValueError(f"stages start at steps {firsts}; expected 0 and then growing steps")
        for s in self.stages:
            if s.num_tokens % (self.world_size * self.grad_accum):
                raise ValueError(f"{s.num_tokens} tokens do not divide into {self.world_size} ranks x {self.grad_accum} micro-steps")

    def n_local(self, stage: int) -> int:
        return self.stages[stage].num_tokens // self.grad_accum // self.world_size

    @property
    def first_calls(self) -> list[int]:
        return [s.first_step * self.grad_accum for s in self.stages]

    def stage_of(self, call: int) -> int:
        return int(np.searchsorted(self.first_calls, call, "right")) - 1


class ShardSpans:
    """One shard's documents, with prefix sums of their lengths under every stage's cut."""

    def __init__(self, pdf: pd.DataFrame, schedule: Schedule):
        pdf = pdf.sort_values("doc_idx", kind="stable")
        self.schedule = schedule
        self.doc_idx = pdf["doc_idx"].to_numpy(np.int64)
        self.starts = pdf["start_idx"].to_numpy(np.int64)
        lengths = pdf["end_idx"].to_numpy(np.int64) - self.starts
        self.lengths = [np.minimum(lengths, s.max_seq_len) for s in schedule.stages]
        self.sums = [np.concatenate(([0], np.cumsum(n))) for n in self.lengths]

    def call(self, stage: int, at: int) -> list[int] | None:
        """First document of each rank's slice and the one after the call; None if the shard has too few left."""
        need, sums, edges = self.schedule.n_local(stage) + 1, self.sums[stage], [at]
        for _ in range(self.schedule.world_size):
            at = int(np.searchsorted(sums, sums[at] + need, "left"))
            if at >= len(sums):
                return None
            edges.append(at)
        return edges

    def count(self, stage: int) -> int:
        """Calls from the first document on, all under one stage."""
        n, edges = 0, self.call(stage, 0)
        while edges:
            n, edges = n + 1, self.call(stage, edges[-1])
        return n

    def walk(self, call: int) -> Iterator[tuple[int, int, list[int]]]:
        """(call number, stage, edges) of every call, from the number the shard is entered with."""
        at = 0
        while True:
            stage = self.schedule.stage_of(call)
            edges = self.call(stage, at)
            if edges is None:
                return
            yield call, stage, edges
            call, at = call + 1, edges[-1]


def calls_per_stage(spans: DataFrame, schedule: Schedule) -> DataFrame:
    """``shard_id, stage, n_calls, base``: calls of each whole shard under each stage, and those of all shards before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = ShardSpans(pdf, schedule)
        stages = range(len(schedule.stages))
        return pd.DataFrame({"shard_id": [int(pdf["shard_id"].iloc[0])] * len(stages), "stage": list(stages),
                             "n_calls": [shard.count(s) for s in stages]})

    counts = spans.groupBy("shard_id").applyInPandas(run, "shard_id int, stage int, n_calls long")
    return prefix_sum(counts, "shard_id", "n_calls", "base", partition_cols=["stage"])


def first_calls(spans: DataFrame, schedule: Schedule) -> DataFrame:
    """``shard_id, first_call``: the call number every shard is entered with."""
    spark = spans.sparkSession
    counts = cut_lineage(calls_per_stage(spans, schedule).groupBy("shard_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("stage", "n_calls", "base"))),
                    lambda x: F.struct(x["n_calls"].alias("n"), x["base"].alias("base"))).alias("by_stage")))
    bounds = F.array(*[F.lit(c).cast("long") for c in schedule.first_calls])
    n_stages = len(schedule.stages)

    def stage_of(call):
        return F.size(F.filter(bounds, lambda b: b <= call)) - 1

    def last_call(call):  # first call of the next stage; none for the last stage
        return F.when(stage_of(call) < n_stages - 1, F.element_at(bounds, stage_of(call) + 2))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        left = int(pdf["entered"].iloc[0])
        for call, _, _ in ShardSpans(pdf, schedule).walk(left):
            left = call + 1
        return pd.DataFrame({"after": [int(pdf["shard_id"].iloc[0])], "call": [left]})

    # a start: shards after ``after`` are entered from call number ``call`` on, counted beyond the sums in ``passed``
    start = spark.range(1).select(F.lit(-1).alias("after"), F.lit(0).cast("long").alias("call"),
                                  F.array_repeat(F.lit(0).cast("long"), n_stages).alias("passed"))
    starts = start
    for _ in range(n_stages - 1):
        later = counts.join(F.broadcast(start), F.col("shard_id") > F.col("after"))
        own = F.element_at("by_stage", stage_of(F.col("call")) + 1)
        entered = F.col("call") + own["base"] - F.element_at("passed", stage_of(F.col("call")) + 1)
        reaching = later.where(entered + own["n"] >= last_call(F.col("call")))
        first = reaching.agg(F.min_by(F.struct("shard_id", entered.alias("entered"), F.transform(
            "by_stage", lambda x: x["base"] + x["n"]).alias("passed")), "shard_id").alias("x")).where("x IS NOT NULL").select("x.*")
        left = spans.join(F.broadcast(first.select("shard_id", "entered")), "shard_id").groupBy("shard_id").applyInPandas(
            walk, "after int, call long")
        start = cut_lineage(left.join(first.select(F.col("shard_id").alias("after"), "passed"), "after"))
        starts = starts.unionByName(start)
    entered = counts.join(F.broadcast(starts), F.col("shard_id") > F.col("after")).groupBy("shard_id").agg(
        F.max_by(F.struct("call", "passed", "by_stage"), "after").alias("x"))
    stage = stage_of(F.col("x.call")) + 1
    return entered.select("shard_id", (F.col("x.call") + F.element_at("x.by_stage", stage)["base"]
                                       - F.element_at("x.passed", stage)).alias("first_call"))


PLAN_SCHEMA = ("step long, micro int, rank int, stage int, shard_id int, shard_stem string, piece int, doc_idx long, "
               "start_idx long, end_idx long")


def staged_plan(spans: DataFrame, schedule: Schedule) -> DataFrame:
    """Pieces ``(step, micro, rank, stage, shard, piece, doc_idx, start_idx, end_idx)`` of every call.

    As in the plan of one stage, a call that a shard cannot complete is dropped and
    the next shard starts afresh; the call keeps its number, step and stage there.
    """
    spans = cut_lineage(spans.select("shard_id", "shard_stem", "doc_idx", "start_idx", "end_idx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, slices = ShardSpans(pdf, schedule), []
        for call, stage, edges in shard.walk(int(pdf["first_call"].iloc[0])):
            sums, need = shard.sums[stage], schedule.n_local(stage) + 1
            for rank, (a, b) in enumerate(zip(edges, edges[1:])):
                starts = shard.starts[a:b]
                ends = starts + shard.lengths[stage][a:b]
                ends[-1] = starts[-1] + sums[a] + need - sums[b - 1]
                own = np.full((4, b - a), [[call // schedule.grad_accum], [call % schedule.grad_accum], [rank], [stage]])
                slices.append(np.vstack([own, np.arange(b - a), shard.doc_idx[a:b], starts, ends]))
        rows = np.concatenate([*slices, np.empty((8, 0), np.int64)], axis=1)
        out = pd.DataFrame(dict(zip(["step", "micro", "rank", "stage", "piece", "doc_idx", "start_idx", "end_idx"], rows)))
        out["shard_id"] = int(pdf["shard_id"].iloc[0])
        out["shard_stem"] = str(pdf["shard_stem"].iloc[0])
        return out

    return spans.join(first_calls(spans, schedule), "shard_id").groupBy("shard_id").applyInPandas(run, PLAN_SCHEMA)
