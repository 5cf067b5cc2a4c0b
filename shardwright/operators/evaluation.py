"""Multiple-choice evaluation.

Packing (E3) is the only sequential rule: per rank, tasks in order fill a
sequence until the next task would reach ``seq_len``.  It runs per rank on
token *counts* only (task id and five integers per row); spans, padding and
scores are column arithmetic and joins afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BOS_ID, EVAL_DOC_LEN_MIN_AVERAGE
from .ordering import global_row_number

SHUFFLE_MUL = 2654435761  # Knuth's multiplicative hash constant


def shuffle_key(item_id: Column, seed: int) -> Column:
    """Seeded permutation key (multiplicative hash of id + seed)."""
    return F.pmod((item_id + F.lit(seed)) * F.lit(SHUFFLE_MUL), F.lit(1 << 32).cast("long"))


def assign_ranks(tasks: DataFrame, world_size: int, seed: int) -> DataFrame:
    """Seeded shuffle, then round robin over ranks: shuffled position
    ``i`` goes to rank ``i mod world`` as its ``i div world``-th task."""
    t = tasks.withColumn("__key", shuffle_key(F.col("task_id"), seed))
    t = global_row_number(t, [F.col("__key").asc(), F.col("task_id").asc()], "__pos").drop("__key")
    return t.withColumn("rank", F.pmod(F.col("__pos") - 1, F.lit(world_size)).cast("int")) \
        .withColumn("task_ord", F.floor((F.col("__pos") - 1) / world_size).cast("long")).drop("__pos")


def token_counts(tasks: DataFrame, encoder_len=F.octet_length) -> DataFrame:
    """Context length and the four ending lengths (ending encoded with a
    leading space); exactly four endings required."""
    four = F.size("endings") == 4
    ends = F.transform("endings", lambda e: encoder_len(F.concat(F.lit(" "), e)).cast("int"))
    return tasks.withColumn("ctx_len", encoder_len(F.col("ctx")).cast("int")) \
        .withColumn("end_lens", F.when(four, ends).otherwise(F.raise_error(F.lit("a task needs 4 endings"))))


PACK_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("task_id", T.LongType()),
    T.StructField("seq_no", T.IntegerType()), T.StructField("offset", T.IntegerType())])


def _pack_rank(seq_len: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task_ord", kind="stable")
        c = pdf["ctx_len"].to_numpy(np.int64)
        e = np.stack(pdf["end_lens"].to_numpy()).astype(np.int64) if len(pdf) else np.zeros((0, 4), np.int64)
        total = 4 * c + e.sum(axis=1)
        seq_nos = np.zeros(len(pdf), np.int32)
        offs = np.zeros(len(pdf), np.int32)
        seq, cur = 0, 0
        for i in range(len(pdf)):
            if total[i] >= seq_len:
                raise ValueError(f"task {int(pdf['task_id'].iloc[i])} has {int(total[i])} tokens, "
                                 f"not less than seq_len {seq_len}")
            if cur + total[i] >= seq_len:
                seq, cur = seq + 1, 0
            seq_nos[i], offs[i] = seq, cur
            cur = cur + total[i] - (1 if cur == 0 else 0)
        return pd.DataFrame({"rank": pdf["rank"].astype("int32").to_numpy(), "task_id": pdf["task_id"].to_numpy(),
                             "seq_no": seq_nos, "offset": offs})
    return run


def pack(counted: DataFrame, seq_len: int) -> DataFrame:
    """Sequence number and start offset of every task inside its rank."""
    packed = counted.select("rank", "task_id", "task_ord", "ctx_len", "end_lens") \
        .groupBy("rank").applyInPandas(_pack_rank(seq_len), PACK_SCHEMA)
    return counted.join(packed, ["rank", "task_id"])


def ending_spans(packed: DataFrame, *keep: str) -> DataFrame:
    """One row per ending: ``[start, end)`` of the ending's targets.

    Before ending k of a task at offset ``L0`` there are the separators and
    ``ctx + ending - 1`` tokens of the previous endings; a separator precedes
    every ending except the first of a sequence.  ``keep`` names further columns.
    """
    ex = packed.select("*", F.posexplode("end_lens").alias("ending_id", "end_len"))
    c = F.col("ctx_len").cast("long")
    k = F.col("ending_id")
    # tokens of the earlier endings of this task (context + ending - 1 each)
    base = F.aggregate(F.slice("end_lens", 1, k), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") + c - 1)
    # separators up to and including ending k: all but the very first of a sequence
    seps = k + 1 - F.when(F.col("offset") == 0, 1).otherwise(0)
    pos = F.col("offset") + base + seps
    start = pos + c - 1
    return ex.select("rank", "seq_no", "task_id", "label", F.col("ending_id").cast("int").alias("ending_id"),
                     start.cast("long").alias("span_start"), (start + F.col("end_len")).cast("long").alias("span_end"),
                     pos.cast("long").alias("piece_start"), *keep)


def doc_end_positions(spans: DataFrame, seq_len: int) -> DataFrame:
    """E5: ``[0, sep+1 ..., seq_len ...]`` with separator positions (one
    before every ending that is not the first of its sequence), padded to
    ``((seq_len // 70) // 128 + 1) * 128``; more separators than that raise."""
    max_docs = ((seq_len // EVAL_DOC_LEN_MIN_AVERAGE) // 128 + 1) * 128
    ends = spans.where(F.col("piece_start") > 0).select("rank", "seq_no", F.col("piece_start").alias("e"))
    per = ends.groupBy("rank", "seq_no").agg(F.array_sort(F.collect_list("e")).alias("ends"))
    fits = F.size("ends") < max_docs
    per = per.withColumn("ends", F.when(fits, F.col("ends")).otherwise(F.raise_error(F.concat(
        F.lit("a sequence has "), F.size("ends").cast("string"), F.lit(f" separators, the capacity is {max_docs - 1}")))
        .cast("array<bigint>")))
    padded = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"),
                      F.array_repeat(F.lit(seq_len).cast("long"), (F.lit(max_docs - 1) - F.size("ends")).cast("int")))
    return per.select("rank", "seq_no", F.size("ends").cast("int").alias("n_separators"), padded.alias("doc_end_positions"))


def byte_ids(text: str) -> list[int]:
    return list(text.encode())


def token_sequences(packed: DataFrame, seq_len: int, encode: Callable[[str], list[int]] = byte_ids, pad_id: int = 0) -> DataFrame:
    """E2/E4/E5 tokens: ``rank, seq_no, inputs, targets`` of every packed sequence, each ``seq_len`` ids long.

    Every ending brings its context and itself, shifted by one between inputs and
    targets; a delimiter stands in both before every ending but a sequence's first, and
    ``pad_id`` fills the end.  ``encode`` must be the encoder whose lengths were packed; a
    piece that then overlaps the next one is an error.  A group is one sequence.
    """
    pieces = ending_spans(packed, "ctx", "endings")
    piece = F.struct("piece_start", "ctx", F.concat(F.lit(" "), F.element_at("endings", F.col("ending_id") + 1)).alias("ending"))
    grouped = pieces.groupBy("rank", "seq_no").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.full((2, batch.num_rows, seq_len), pad_id, np.int32)
            for row, own in enumerate(batch.column("pieces").to_pylist()):
                filled = 0
                for p in own:
                    ids, at = encode(p["ctx"]) + encode(p["ending"]), p["piece_start"]
                    if at - (at > 0) != filled or at + len(ids) - 1 > seq_len:
                        raise ValueError(f"a piece of {len(ids)} ids at {at} does not follow the {filled} before it")
                    if at:
                        both[:, row, at - 1] = BOS_ID
                    filled = at + len(ids) - 1
                    both[0, row, at:filled] = ids[:-1]
                    both[1, row, at:filled] = ids[1:]
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * seq_len)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), batch.column("seq_no"), *(pa.ListArray.from_arrays(bounds, pa.array(x.ravel())) for x in both)],
                names=["rank", "seq_no", "inputs", "targets"])

    return grouped.mapInArrow(run, "rank int, seq_no int, inputs array<int>, targets array<int>")


def score(spans: DataFrame, token_loss: DataFrame) -> DataFrame:
    """Mean target loss per ending; lowest mean wins, first on ties.

    ``token_loss(rank, seq_no, pos, loss)``; each span explodes its own
    positions (equi-join on ``(rank, seq_no, pos)``)."""
    pos = spans.select("rank", "seq_no", "task_id", "label", "ending_id",
                       F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("pos"))
    j = pos.join(token_loss, ["rank", "seq_no", "pos"])
    per_end = j.groupBy("rank", "task_id", "label", "ending_id").agg(F.avg("loss").alias("avg_loss"))
    best = per_end.groupBy("rank", "task_id", "label").agg(
        F.min_by("ending_id", F.struct("avg_loss", "ending_id")).alias("predicted"))
    return best.withColumn("correct", (F.col("predicted") == F.col("label")))


def accuracy(scored: DataFrame) -> DataFrame:
    """Correct and count summed over ranks."""
    return scored.agg(F.sum(F.col("correct").cast("long")).alias("n_correct"),
                      F.count(F.lit(1)).cast("long").alias("n_count")) \
        .withColumn("accuracy", F.col("n_correct") / F.col("n_count"))


def validation_loss(token_loss: DataFrame, batch_size: int, world_size: int) -> DataFrame:
    """Per-token losses at stream positions ``pos``; batches of
    ``batch_size`` tokens split over ranks; mean per (batch, rank), mean over
    batches, mean over ranks.  The stream must be whole batches: one that is
    not raises, since its last ranks would have fewer tokens than the others."""
    if batch_size % world_size:
        raise ValueError(f"batch size {batch_size} is not divisible by {world_size} ranks")
    n_local = batch_size // world_size
    t = token_loss.select((F.floor(F.col("pos") / batch_size)).alias("batch"),
                          (F.floor(F.pmod(F.col("pos"), F.lit(batch_size)) / n_local)).alias("rank"), "loss")
    whole = F.count(F.lit(1)) == n_local
    per = t.groupBy("batch", "rank").agg(F.when(whole, F.avg("loss")).otherwise(
        F.raise_error(F.lit(f"a batch holds less than {batch_size} tokens")).cast("double")).alias("l"))
    per_rank = per.groupBy("rank").agg(F.avg("l").alias("l"), F.count(F.lit(1)).alias("n_batches"))
    alike = (F.min("n_batches") == F.max("n_batches")) & (F.count(F.lit(1)) == world_size)
    return per_rank.agg(
        F.avg("l").alias("val_loss"), F.when(alike, F.max("n_batches")).otherwise(
            F.raise_error(F.lit(f"a batch holds less than {batch_size} tokens")).cast("long")).alias("n_batches"))


def weighted_loss(pos: Column, loss: Column, weights: list[float]) -> Column:
    """Weight by position ``w[pos mod k]``."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.element_at(w, (F.pmod(pos, F.lit(len(weights))) + 1).cast("int")) * loss


def lookahead_loss(losses: DataFrame, weights: list[float], keys: list[str]) -> DataFrame:
    """E9, look-ahead form: ``sum_k w[k] * loss(pos, pos + k)`` per position, cut at the end of its sequence.

    ``losses(keys..., pos, target_pos, loss)`` holds the loss at ``pos`` of the target at
    ``target_pos``; every position has at least its own target's.  A band of offsets meets
    the losses in one equi-join; a loss that is missing inside the sequence is an error.
    """
    positions = losses.where("pos = target_pos").select(*keys, "pos")
    ends = positions.groupBy(*keys).agg((F.max("pos") + 1).alias("__end"))
    offsets = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    band = positions.join(ends, keys).select(*keys, "pos", "__end", F.explode(offsets).alias("o")).select(
        *keys, "pos", (F.col("pos") + F.col("o.k")).alias("target_pos"), F.col("o.w").alias("w"), "__end").where("target_pos < __end")
    missing = F.raise_error(F.concat(F.lit("no loss of position "), F.col("pos").cast("string"), F.lit(" at target "),
                                     F.col("target_pos").cast("string"))).cast("double")
    met = band.join(losses.select(*keys, "pos", "target_pos", "loss"), [*keys, "pos", "target_pos"], "left")
    return met.groupBy(*keys, "pos").agg(F.sum(F.col("w") * F.coalesce("loss", missing)).alias("loss"))


def log_prob_bound(loss: Column, n_tokens: Column) -> Column:
    """Log of ``exp(-loss * tokens)``."""
    return -loss * n_tokens
