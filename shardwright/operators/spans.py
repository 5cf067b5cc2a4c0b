"""Document index over token shards.

Input is the managed shard storage ``token_chunks(shard_id, shard_stem,
chunk_id, start_pos, tokens)`` or, for the corpus the engine wrote itself,
the piece table of ``tokens.shard_pieces`` (a delimiter is the first token of
every document, so its position is known without touching tokens).

Every window here is partitioned by shard (or by slice), so a window
partition never holds more than one shard's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOS_ID, HEADER_TOKENS
from ..functions.encoders import byte_decode_frame
from .ranges import overlap_join
from .tokens import CHUNK_SIZE, with_shard_names


def delimiter_positions(chunks: DataFrame, delimiter: int = BOS_ID) -> DataFrame:
    """Every position of the delimiter, per shard.

    Positions are found inside each chunk array (a higher-order filter over
    indices) and only the hits are exploded, so no per-token rows are made.
    """
    hits = F.filter(
        F.transform("tokens", lambda t, i: F.when(t == F.lit(delimiter), i)),
        lambda i: i.isNotNull())
    return chunks.select("shard_id", "shard_stem", "start_pos", F.explode(hits).alias("i")) \
        .select("shard_id", "shard_stem", (F.col("start_pos") + F.col("i")).cast("long").alias("pos"))


def delimiters_from_pieces(pieces: DataFrame) -> DataFrame:
    """D1 shortcut for a corpus written by this engine: the first piece of a
    document starts with its delimiter."""
    return with_shard_names(
        pieces.where(F.col("doc_start") == 0)
              .select(F.col("shard_id").cast("int").alias("shard_id"), F.col("shard_pos").alias("pos"))
    ).select("shard_id", "shard_stem", "pos")


def shard_sizes_from_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("shard_id", "shard_stem").agg(
        F.sum(F.size("tokens")).cast("long").alias("shard_len"))


def shard_sizes_from_pieces(pieces: DataFrame) -> DataFrame:
    return with_shard_names(
        pieces.groupBy(F.col("shard_id").cast("int").alias("shard_id"))
              .agg(F.sum("piece_len").cast("long").alias("shard_len"))
    ).select("shard_id", "shard_stem", "shard_len")


def train_spans(delims: DataFrame, sizes: DataFrame) -> DataFrame:
    """``[bos_i, bos_{i+1})``; the last document ends at the shard size.

    Tokens before the first delimiter of a shard belong to no span.
    """
    w = Window.partitionBy("shard_id").orderBy("pos")
    return delims.join(sizes.select("shard_id", "shard_len"), "shard_id") \
        .select(
            "shard_id", "shard_stem",
            (F.row_number().over(w) - 1).cast("long").alias("doc_idx"),
            F.col("pos").alias("start_idx"),
            F.coalesce(F.lead("pos").over(w), F.col("shard_len")).cast("long").alias("end_idx"),
        )


def scoring_spans(delims: DataFrame) -> DataFrame:
    """D3: neighbouring delimiters after dropping the first one.

    The first document of a shard (before the second delimiter) and the last
    one (no following delimiter) get no span.  ``raw_start_idx`` /
    ``raw_end_idx`` are the same positions in a whole-file uint16 read
    (header included).
    """
    w = Window.partitionBy("shard_id").orderBy("pos")
    with_next = delims.select("shard_id", "shard_stem", "pos",
                              F.row_number().over(w).alias("rn"),
                              F.lead("pos").over(w).alias("next_pos"))
    return with_next.where((F.col("rn") > 1) & F.col("next_pos").isNotNull()).select(
        "shard_id", "shard_stem",
        (F.col("rn") - 2).cast("long").alias("doc_idx"),
        F.col("pos").cast("long").alias("start_idx"),
        F.col("next_pos").cast("long").alias("end_idx"),
        (F.col("pos") + HEADER_TOKENS).cast("long").alias("raw_start_idx"),
        (F.col("next_pos") + HEADER_TOKENS).cast("long").alias("raw_end_idx"),
    )


def span_tokens(spans: DataFrame, chunks: DataFrame, skip_delimiter: bool = True,
                key_cols: list[str] | None = None, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Tokens of every span, re-assembled from the chunks it touches.

    Range join done as an equi-join: each span explodes the ids of the chunks
    it overlaps (a span of length L touches at most L/chunk + 2 chunks), then
    joins ``(shard_stem, chunk_id)``; only chunks of referenced shards are
    read.  Pieces are put back in position order with ``array_sort`` on
    ``(pos, piece)`` structs; the group is one span, bounded by its length.
    """
    keys = list(key_cols or ["shard_stem", "start_idx", "end_idx"])
    # chunk ids follow from positions: chunk c starts at c * chunk_size
    C = F.lit(int(chunk_size)).cast("long")
    lo = F.col("start_idx") + (1 if skip_delimiter else 0)
    hi = F.col("end_idx")
    s = spans.select(*[F.col(k) for k in dict.fromkeys(keys + ["shard_stem", "start_idx", "end_idx"])]) \
        .withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long")) \
        .where(F.col("__hi") > F.col("__lo"))
    s = s.withColumn("chunk_id", F.explode(F.sequence(
        F.floor(F.col("__lo") / C), F.floor((F.col("__hi") - 1) / C)))) \
        .withColumn("chunk_id", F.col("chunk_id").cast("int"))
    aligned = F.col("start_pos") == F.col("chunk_id") * C
    c = chunks.select("shard_stem", "chunk_id", F.when(aligned, F.col("start_pos")).otherwise(F.raise_error(
        F.lit(f"chunks are not of {int(chunk_size)} tokens")).cast("long")).alias("start_pos"), "tokens")
    j = s.join(c, ["shard_stem", "chunk_id"])
    a = F.greatest(F.col("__lo"), F.col("start_pos"))
    b = F.least(F.col("__hi"), F.col("start_pos") + F.size("tokens"))
    piece = F.slice("tokens", (a - F.col("start_pos") + 1).cast("int"), (b - a).cast("int"))
    parts = j.groupBy(*dict.fromkeys(keys + ["shard_stem", "start_idx", "end_idx"])).agg(
        F.array_sort(F.collect_list(F.struct(a.alias("p"), piece.alias("t")))).alias("parts"))
    out = parts.withColumn("tokens", F.flatten(F.transform("parts", lambda x: x["t"]))).drop("parts")
    # spans with nothing to decode (a lone delimiter) keep an empty array
    empty = spans.select(*dict.fromkeys(keys + ["shard_stem", "start_idx", "end_idx"])) \
        .where((F.col("end_idx") - F.col("start_idx") - (1 if skip_delimiter else 0)) <= 0) \
        .withColumn("tokens", F.array().cast("array<int>"))
    return out.unionByName(empty)


def decode_spans(spans: DataFrame, chunks: DataFrame, key_cols: list[str] | None = None,
                 chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Text of every span, delimiter skipped (byte decoder over Arrow batches)."""
    toks = span_tokens(spans, chunks, skip_delimiter=True, key_cols=key_cols, chunk_size=chunk_size)
    return byte_decode_frame(toks)


def length_stats(spans: DataFrame) -> DataFrame:
    """Document length statistics (tokens per span)."""
    n = (F.col("end_idx") - F.col("start_idx")).cast("double")
    return spans.agg(
        F.count(F.lit(1)).cast("long").alias("n_docs"),
        F.percentile(n, 0.5).alias("median_len"),
        F.avg(n).alias("mean_len"),
        F.min(n).cast("long").alias("min_len"),
        F.max(n).cast("long").alias("max_len"),
    )


def slice_doc_runs(slices: DataFrame, spans: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """D8 in run-length form: within every slice, the document id of a token is
    the inclusive running count of delimiters up to it.

    ``slices(slice keys..., shard_id, slice_start, slice_end)`` are token
    ranges of one shard.  A slice meets the spans it overlaps through a
    bucketed interval join (``ranges.overlap_join``); each overlap is a run
    of equal document id.  Tokens
    before the first delimiter of the slice (also the shard head before its
    first delimiter) get id 0.  One row per (slice, run), not per token.
    """
    sp = spans.select("shard_id", "doc_idx", "start_idx", "end_idx", F.lit(True).alias("is_doc"))
    head = spans.groupBy("shard_id").agg(F.min("start_idx").alias("end_idx")) \
        .where(F.col("end_idx") > 0) \
        .select("shard_id", F.lit(-1).cast("long").alias("doc_idx"), F.lit(0).cast("long").alias("start_idx"),
                "end_idx", F.lit(False).alias("is_doc"))
    sp = sp.unionByName(head)
    j = overlap_join(slices, sp, ["shard_id"], ("slice_start", "slice_end"), ("start_idx", "end_idx"),
                     width=bucket_width)
    run_lo = F.greatest(F.col("start_idx"), F.col("slice_start"))
    run_hi = F.least(F.col("end_idx"), F.col("slice_end"))
    starts_inside = (F.col("is_doc") & (F.col("start_idx") >= F.col("slice_start"))).cast("int")
    keep = [c for c in slices.columns if c not in ("slice_start", "slice_end")]
    return j.select(*keep, "doc_idx", starts_inside.alias("__in"),
                    (run_lo - F.col("slice_start")).cast("long").alias("run_start"),
                    (run_hi - F.col("slice_start")).cast("long").alias("run_end"))


def with_doc_ids(runs: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Turn span indices of ``slice_doc_runs`` into per-slice document ids."""
    w = Window.partitionBy(*slice_keys)
    first_inside = F.min(F.when(F.col("__in") == 1, F.col("doc_idx"))).over(w)
    doc_id = F.when(F.col("__in") == 0, F.lit(0)).otherwise(F.col("doc_idx") - first_inside + 1)
    return runs.withColumn("doc_id", doc_id.cast("long")).drop("__in", "doc_idx")


def block_doc_ranges(runs: DataFrame, slice_keys: list[str], block: int) -> DataFrame:
    """First and last document id of every ``block``-token block of a slice.

    A run ``[run_start, run_end)`` covers blocks ``run_start div block`` to
    ``(run_end-1) div block``; low / high of a block are the ids of the runs
    holding its first and last token.
    """
    B = F.lit(block).cast("long")
    r = runs.withColumn("blk", F.explode(F.sequence(F.floor(F.col("run_start") / B),
                                                     F.floor((F.col("run_end") - 1) / B))))
    return r.groupBy(*slice_keys, "blk").agg(
        F.min("doc_id").alias("doc_low"), F.max("doc_id").alias("doc_high")) \
        .select(*slice_keys, F.col("blk").cast("long").alias("blk"), "doc_low", "doc_high")


def block_pairs(blocks: DataFrame, slice_keys: list[str], window_blocks: int | None = None) -> DataFrame:
    """Causal block pairs that share a document.

    Interval-overlap self-join inside one slice (equi-key on the slice):
    ``kv <= q`` and ``low_q <= high_kv`` (ids grow with position, so this is
    overlap of ``[low, high]``).  ``full`` when ``kv < q`` and both blocks lie
    in one and the same document.  ``window_blocks`` keeps ``q - kv < w``.
    """
    q = blocks.select(*slice_keys, F.col("blk").alias("q_blk"),
                      F.col("doc_low").alias("q_low"), F.col("doc_high").alias("q_high"))
    kv = blocks.select(*slice_keys, F.col("blk").alias("kv_blk"),
                       F.col("doc_low").alias("kv_low"), F.col("doc_high").alias("kv_high"))
    cond = (F.col("kv_blk") <= F.col("q_blk")) & (F.col("q_low") <= F.col("kv_high"))
    if window_blocks is not None:
        cond = cond & ((F.col("q_blk") - F.col("kv_blk")) < F.lit(window_blocks))
    pairs = q.join(kv, slice_keys).where(cond)
    full = (F.col("kv_blk") < F.col("q_blk")) & (F.col("q_low") == F.col("q_high")) & \
        (F.col("kv_low") == F.col("kv_high")) & (F.col("q_low") == F.col("kv_low"))
    return pairs.select(*slice_keys, "q_blk", "kv_blk", full.alias("is_full"))


def block_mask_counts(pairs: DataFrame, slice_keys: list[str], window_blocks: int | None = None) -> DataFrame:
    """D10 counts per q block; with ``window_blocks`` the
    caps of the medium-track variant: full <= w-1, partial <= max(w-full, 1)."""
    agg = pairs.groupBy(*slice_keys, "q_blk").agg(
        F.count_if(F.col("is_full")).cast("long").alias("n_full"),
        F.count_if(~F.col("is_full")).cast("long").alias("n_partial"))
    if window_blocks is None:
        return agg
    n_full_cap = F.least(F.col("n_full"), F.lit(window_blocks - 1))
    n_part_cap = F.least(F.col("n_partial"), F.greatest(F.lit(window_blocks) - n_full_cap, F.lit(1)))
    return agg.select(*slice_keys, "q_blk", n_full_cap.cast("long").alias("n_full"),
                      n_part_cap.cast("long").alias("n_partial"))


def block_mask_ranges(runs: DataFrame, slice_keys: list[str], block: int) -> DataFrame:
    """D10 without pairs: per q block the kv blocks it needs, as two ranges and itself.

    Document ids grow with position, so the kv blocks that share a document with block
    ``q`` are those from the first block of ``q``'s first document on.  Full ones lie,
    like ``q``, wholly inside one document: from its first whole block to ``q - 1``.  All
    else, ``q`` itself included, is partial.  One equi-join of blocks with the run
    that holds their first token; a slice of ``n`` blocks gives ``n`` rows, not
    ``n * n`` pairs.  Returns ``q_blk, kv_first, full_first, full_stop``.
    """
    blocks = block_doc_ranges(runs, slice_keys, block)
    own = runs.select(*slice_keys, F.col("doc_id").alias("doc_low"), "run_start")
    q = blocks.join(own, [*slice_keys, "doc_low"])
    first = F.floor(F.col("run_start") / block).cast("long")
    whole = F.ceil(F.col("run_start") / block).cast("long")
    full_first = F.when(F.col("doc_low") == F.col("doc_high"), F.least(whole, F.col("blk"))).otherwise(F.col("blk"))
    return q.select(*slice_keys, F.col("blk").alias("q_blk"), first.alias("kv_first"), full_first.alias("full_first"),
                    F.col("blk").alias("full_stop"))


def _falling(first, stop):
    """Blocks of ``[first, stop)``, nearest to the end first."""
    return F.when(stop > first, F.sequence(stop - 1, first, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))


def block_mask_lists(ranges: DataFrame, slice_keys: list[str], window_blocks: int | None = None,
                     cap_blocks: int | None = None) -> DataFrame:
    """D10 lists per q block, nearest first: ``full_kv`` and ``partial_kv``.

    ``window_blocks`` keeps ``q - kv < w``; ``cap_blocks`` keeps the nearest ``w - 1``
    full and the nearest ``max(w - full, 1)`` partial blocks.
    """
    q = F.col("q_blk")
    low = F.lit(0).cast("long") if window_blocks is None else F.greatest(q - (window_blocks - 1), F.lit(0).cast("long"))
    full = _falling(F.greatest("full_first", low), F.col("full_stop"))
    partial = F.concat(F.array(q), _falling(F.greatest("kv_first", low), F.col("full_first")))
    if cap_blocks is not None:
        full = F.slice(full, 1, cap_blocks - 1) if cap_blocks > 1 else F.array().cast("array<long>")
        partial = F.slice(partial, F.lit(1), F.greatest(F.lit(cap_blocks) - F.size(full), F.lit(1)))
    return ranges.select(*slice_keys, "q_blk", full.alias("full_kv"), partial.alias("partial_kv"))
