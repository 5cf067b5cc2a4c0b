"""Batch plan over token shards.

Aligned packing (B1) is a sequential greedy rule inside one shard: each
slice takes documents from the next delimiter until it holds ``N + 1``
tokens, every document cut to ``max_seq_len``, the last one to what is left.
With ``L = least(len, max_seq_len)`` and prefix sums ``P`` the next slice
starts at the first document ``j`` with ``P[j] >= P[s] + N + 1``; following
that pointer from 0 gives every slice.  It runs as one grouped function per
shard over span rows only (a shard has a fixed token budget, so the group is
bounded whatever the corpus size), and shards are planned in parallel.

Steps are numbered across shards with a prefix sum over per-shard call
counts (one row per shard).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BIGRAM_MUL_CUR, BIGRAM_MUL_PREV, BIGRAM_VOCAB_SIZE, BOS_ID, MAX_NUM_DOCS
from .ordering import prefix_sum

PIECE_SCHEMA = T.StructType([
    T.StructField("shard_id", T.IntegerType()),
    T.StructField("shard_stem", T.StringType()),
    T.StructField("slice_k", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("doc_idx", T.LongType()),
    T.StructField("start_idx", T.LongType()),
    T.StructField("end_idx", T.LongType()),
])


def _pack_shard(n_tokens: int, max_seq_len: int):
    need = n_tokens + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_idx", kind="stable")
        starts = pdf["start_idx"].to_numpy(np.int64)
        lens = np.minimum(pdf["end_idx"].to_numpy(np.int64) - starts, max_seq_len)
        doc_idx = pdf["doc_idx"].to_numpy(np.int64)
        n = len(starts)
        P = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(lens, out=P[1:])
        out_k, out_piece, out_doc, out_s, out_e = [], [], [], [], []
        s, k = 0, 0
        while s < n:
            j = int(np.searchsorted(P, P[s] + need, side="left"))
            if j > n:          # not enough documents left in this shard
                break
            idx = np.arange(s, j)
            ends = starts[idx] + lens[idx]
            ends[-1] = starts[j - 1] + (P[s] + need - P[j - 1])
            out_k.append(np.full(len(idx), k, dtype=np.int64))
            out_piece.append(np.arange(len(idx), dtype=np.int32))
            out_doc.append(doc_idx[idx])
            out_s.append(starts[idx])
            out_e.append(ends)
            s, k = j, k + 1
        if not out_k:
            return pd.DataFrame({c.name: pd.Series([], dtype="int64") for c in PIECE_SCHEMA.fields}) \
                .astype({"shard_stem": "object", "shard_id": "int32", "piece": "int32"})
        m = sum(len(a) for a in out_k)
        return pd.DataFrame({
            "shard_id": np.full(m, int(pdf["shard_id"].iloc[0]), dtype=np.int32),
            "shard_stem": [pdf["shard_stem"].iloc[0]] * m,
            "slice_k": np.concatenate(out_k),
            "piece": np.concatenate(out_piece),
            "doc_idx": np.concatenate(out_doc),
            "start_idx": np.concatenate(out_s),
            "end_idx": np.concatenate(out_e),
        })

    return run


def aligned_slices(spans: DataFrame, n_tokens: int, max_seq_len: int) -> DataFrame:
    """B1/B2: pieces ``(shard, slice_k, piece, start_idx, end_idx)`` of every
    slice of ``n_tokens + 1`` tokens; incomplete tail slices are absent."""
    return spans.select("shard_id", "shard_stem", "doc_idx", "start_idx", "end_idx") \
        .groupBy("shard_id").applyInPandas(_pack_shard(n_tokens, max_seq_len), PIECE_SCHEMA)


def batch_plan(spans: DataFrame, num_tokens: int, max_seq_len: int, world_size: int,
               grad_accum: int, train_only: bool = True) -> DataFrame:
    """The aligned batch plan.

    One loader call makes ``world_size`` slices of ``num_tokens //
    (grad_accum * world_size)`` tokens; a call that cannot be completed
    inside a shard is dropped and the next shard starts fresh (B3).  Calls
    are numbered across shards in shard order; ``step = call div
    grad_accum``, ``micro = call mod grad_accum`` (B4).
    """
    assert num_tokens % (world_size * grad_accum) == 0, "token budget must divide"
    n_local = num_tokens // grad_accum // world_size
    if train_only:
        spans = spans.where(F.col("shard_id") > 0)
    pieces = aligned_slices(spans, n_local, max_seq_len)
    counts = pieces.groupBy("shard_id").agg((F.max("slice_k") + 1).alias("n_slices"))
    calls = counts.select("shard_id", (F.floor(F.col("n_slices") / world_size)).cast("long").alias("n_calls"))
    # shard order = shard_id (file names sort the same way); one row per shard
    bases = prefix_sum(calls, "shard_id", "n_calls", "call_base")
    plan = pieces.join(bases.select("shard_id", "n_calls", "call_base"), "shard_id") \
        .where(F.col("slice_k") < F.col("n_calls") * world_size)
    call = F.col("call_base") + F.floor(F.col("slice_k") / world_size)
    return plan.select(
        (call / grad_accum).cast("long").alias("step"),
        F.pmod(call, F.lit(grad_accum)).cast("int").alias("micro"),
        F.pmod(F.col("slice_k"), F.lit(world_size)).cast("int").alias("rank"),
        "shard_id", "shard_stem", "slice_k", "piece", "doc_idx", "start_idx", "end_idx",
    )


def slice_cum_lengths(plan: DataFrame, n_local: int, max_num_docs: int = MAX_NUM_DOCS) -> DataFrame:
    """Cumulative document ends of every slice, the last end minus one
    (targets are shifted), padded ``[0, ends..., N, N...]`` to ``max_num_docs``.
    More than ``max_num_docs - 1`` documents is an error."""
    keys = ["step", "micro", "rank"]
    so_far = F.sum(F.col("end_idx") - F.col("start_idx")).over(
        Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    lens = plan.withColumn("so_far", so_far).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("piece", "so_far"))).alias("p"))
    n = F.transform("p", lambda x: x["so_far"])
    last = F.size(n)
    cum = F.transform(n, lambda x, i: F.when(i == last - 1, x - 1).otherwise(x))
    too_many = F.size(cum) > F.lit(max_num_docs - 1)
    padded = F.when(too_many, F.raise_error(F.lit("more documents in a slice than max_num_docs - 1"))) \
        .otherwise(F.concat(F.array(F.lit(0).cast("long")), cum,
                            F.array_repeat(F.lit(n_local).cast("long"),
                                           (F.lit(max_num_docs - 1) - F.size(cum)).cast("int"))))
    return lens.select(*keys, F.size(n).cast("int").alias("n_docs"), padded.alias("cum_lengths"))


def docs_per_slice(plan: DataFrame) -> DataFrame:
    """Documents per slice."""
    return plan.groupBy("step", "micro", "rank").agg(F.count(F.lit(1)).cast("long").alias("n_docs"))


def max_docs_capacity(n_local: Column) -> Column:
    """Padded document capacity for a slice size: the published map,
    else the next multiple of 128 of ``N // 300``."""
    fallback = (F.ceil((F.floor(n_local / 300)) / 128) * 128).cast("long")
    fallback = F.greatest(fallback, F.lit(128).cast("long"))
    return F.when(n_local == 16384, 64).when(n_local == 32768, 96).when(n_local == 49152, 128) \
        .otherwise(fallback).cast("long")


def unaligned_windows(sizes: DataFrame, num_tokens: int, world_size: int, grad_accum: int = 1) -> DataFrame:
    """Contiguous windows ``[pos + r*N, pos + (r+1)*N + 1)``; a file is
    left when ``pos + B + 1 >= len`` (B = tokens per call)."""
    B = num_tokens // grad_accum
    n_local = B // world_size
    n_calls = F.greatest(F.floor((F.col("shard_len") - B - 2) / B) + 1, F.lit(0)).cast("long")
    per = sizes.select("shard_id", "shard_stem", "shard_len", n_calls.alias("n_calls"))
    bases = prefix_sum(per, "shard_id", "n_calls", "call_base")
    calls = bases.where(F.col("n_calls") > 0).withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_calls") - 1)))
    calls = calls.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world_size - 1))))
    call = F.col("call_base") + F.col("k")
    start = F.col("k") * B + F.col("rank") * n_local
    return calls.select(
        (call / grad_accum).cast("long").alias("step"),
        F.pmod(call, F.lit(grad_accum)).cast("int").alias("micro"),
        F.col("rank").cast("int").alias("rank"),
        "shard_id", "shard_stem",
        start.cast("long").alias("slice_start"),
        (start + n_local + 1).cast("long").alias("slice_end"),
    )


def _wrap32(c: Column) -> Column:
    """Two's-complement int32 wrap of a long (torch int32 arithmetic)."""
    two31 = F.lit(1 << 31).cast("long")
    return F.pmod(c + two31, F.lit(1 << 32).cast("long")) - two31


def bigram_hash(tokens: Column, vocab_size: int = BIGRAM_VOCAB_SIZE) -> Column:
    """Position 0 -> V-1; else ``(36313*cur XOR 27191*prev) mod (V-1)``
    in int32 arithmetic; crosses document borders."""
    mod = F.lit(vocab_size - 1).cast("long")
    # previous token of every position (null at 0); the array is shifted once
    # per row, never indexed per element
    prev = F.concat(F.array(F.lit(None).cast("int")), F.slice(tokens, 1, F.size(tokens) - 1))

    def h(cur, p):
        a = _wrap32(cur.cast("long") * BIGRAM_MUL_CUR)
        b = _wrap32(p.cast("long") * BIGRAM_MUL_PREV)
        return F.when(p.isNull(), mod).otherwise(F.pmod(a.bitwiseXOR(b), mod))

    return F.zip_with(tokens, prev, h)


def slice_buffers(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """B5 input: the ``N + 1`` tokens of every slice, pieces in order."""
    from .spans import span_tokens
    keys = ["step", "micro", "rank", "piece"]
    toks = span_tokens(plan.select(*keys, "shard_stem", "start_idx", "end_idx"), chunks,
                       skip_delimiter=False, key_cols=keys)
    return toks.groupBy("step", "micro", "rank").agg(
        F.array_sort(F.collect_list(F.struct("piece", "tokens"))).alias("p")) \
        .select("step", "micro", "rank", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("buf"))


def inputs_targets(buffers: DataFrame) -> DataFrame:
    """inputs = buf[:-1], targets = buf[1:]."""
    n = F.size("buf") - 1
    return buffers.select("step", "micro", "rank",
                          F.slice("buf", 1, n).alias("inputs"), F.slice("buf", 2, n).alias("targets"))


def delimiter_ends(inputs: Column) -> Column:
    """Document ends of an unaligned slice = delimiter positions in inputs."""
    return F.filter(F.transform(inputs, lambda t, i: F.when(t == F.lit(BOS_ID), i)), lambda i: i.isNotNull())


def cyclic_loader(sizes: DataFrame, B: int, T: int, n_procs: int, epochs: int, rule: str = "gt_plus1") -> DataFrame:
    """The older multi-epoch loader: process ``r`` reads ``B*T + 1``
    tokens at ``r*B*T + k*B*T*P`` of each file, files in name order, cycling.

    Roll-over after a batch at position ``p``: ``rule="gt_plus1"`` leaves the
    file when ``p + 2*B*T*P + 1 > len``; ``rule="ge"`` when ``p + 2*B*T*P >= len``.
    A file must hold a batch of every process, ``B*T*P + 1`` tokens; a shorter
    one raises.  Counts depend on the rank, as in the reference.  Batch numbers
    per rank come from a prefix sum over the files of one epoch; the epochs
    before add the same number of batches each, so any shard id will do.
    """
    BT = B * T
    step = BT * n_procs
    enough = F.col("shard_len") >= step + 1
    too_short = F.raise_error(F.concat(F.col("shard_stem"), F.lit(f" holds less than {step + 1} tokens")))
    files = sizes.select("shard_id", "shard_stem", F.when(enough, F.col("shard_len")).otherwise(
        too_short.cast("long")).alias("shard_len"))
    ranks = files.sparkSession.range(n_procs).select(F.col("id").cast("int").alias("rank"))
    ep = files.sparkSession.range(epochs).select(F.col("id").cast("int").alias("epoch"))
    fr = files.crossJoin(F.broadcast(ranks))
    base = F.col("shard_len") - F.col("rank") * BT
    if rule == "gt_plus1":
        extra = F.floor((base - 1) / step) - 1
    elif rule == "ge":
        extra = F.ceil(base / step) - 2
    else:
        raise ValueError(f"unknown roll-over rule {rule}")
    fr = fr.withColumn("n_batches", (F.greatest(extra, F.lit(0)) + 1).cast("long"))
    an_epoch = fr.groupBy("rank").agg(F.sum("n_batches").alias("epoch_batches"))
    fr = prefix_sum(fr, "shard_id", "n_batches", "batch_base", partition_cols=["rank"])
    fr = fr.join(an_epoch, "rank").crossJoin(F.broadcast(ep)).withColumn(
        "batch_base", F.col("batch_base") + F.col("epoch") * F.col("epoch_batches"))
    out = fr.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_batches") - 1)))
    start = F.col("rank") * BT + F.col("k") * step
    return out.select("rank", (F.col("batch_base") + F.col("k")).cast("long").alias("batch_no"), "epoch",
                      "shard_stem", start.cast("long").alias("start_pos"), (start + BT + 1).cast("long").alias("end_pos"))
