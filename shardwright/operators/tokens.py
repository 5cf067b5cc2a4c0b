"""Tokenise and shard.

Corpus order is an explicit ordinal column (``doc_ord``); partition order is
never used.  A document's global token offset is a two-level prefix sum over
``doc_ord`` (ordering.prefix_sum).  The token at global offset ``g`` belongs
to shard ``g div shard_size``; a document crossing a border is cut into
pieces, so every shard except the last holds exactly ``shard_size`` tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BOS_ID, SHARD_NAME_FORMAT, SHARD_STEM_FORMAT, TOKEN_LIMIT
from ..functions.encoders import byte_length, byte_tokenize_frame, encode_document, text_slices
from .ordering import prefix_sum

CHUNK_SIZE = 65536  # tokens per stored chunk row of a shard


def document_lengths(corpus: DataFrame, encoder: str | Callable = "byte") -> DataFrame:
    """``(doc_ord, n_tokens, ...)``; byte encoder needs no token arrays."""
    if encoder == "byte":
        return corpus.withColumn("n_tokens", (byte_length(F.col("text")) + 1).cast("int"))
    return corpus.withColumn("tokens", encode_document(F.col("text"), encoder)) \
                 .withColumn("n_tokens", F.size("tokens"))


def tokenize(corpus: DataFrame, encoder: str | Callable = "byte") -> DataFrame:
    """``(doc_ord, tokens, n_tokens)``; delimiter first."""
    if encoder == "byte":
        return byte_tokenize_frame(corpus.select("doc_ord", "text")).withColumn("n_tokens", F.size("tokens"))
    return corpus.select(
        "doc_ord", encode_document(F.col("text"), encoder).alias("tokens")
    ).withColumn("n_tokens", F.size("tokens"))


def validate_tokens(doc_tokens: DataFrame) -> DataFrame:
    """Per document, ids outside ``[0, 65536)`` and the first-token check."""
    bad = F.filter("tokens", lambda t: (t < 0) | (t >= TOKEN_LIMIT))
    return doc_tokens.select(
        "doc_ord",
        F.size(bad).alias("n_invalid"),
        (F.col("tokens")[0] == F.lit(BOS_ID)).alias("starts_with_delimiter"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
    )


def document_offsets(doc_lens: DataFrame) -> DataFrame:
    """T4: global offset of each document's delimiter (exclusive running sum)."""
    return prefix_sum(doc_lens, "doc_ord", "n_tokens", "doc_offset")


def shard_pieces(offsets: DataFrame, shard_size: int) -> DataFrame:
    """One row per (document, shard) piece.

    ``doc_start`` is the piece's first token inside the document,
    ``shard_pos`` its position inside the shard, ``piece_len`` its length.
    """
    S = F.lit(shard_size).cast("long")
    off = F.col("doc_offset")
    end = off + F.col("n_tokens")
    first = F.floor(off / S).cast("long")
    last = F.floor((end - 1) / S).cast("long")
    exploded = offsets.withColumn("shard_id", F.explode(F.sequence(first, last)))
    g0 = F.greatest(off, F.col("shard_id") * S)
    g1 = F.least(end, (F.col("shard_id") + 1) * S)
    return exploded.withColumn("doc_start", (g0 - off).cast("long")) \
        .withColumn("shard_pos", (g0 - F.col("shard_id") * S).cast("long")) \
        .withColumn("piece_len", (g1 - g0).cast("long"))


def shard_split(shard_id) -> "F.Column":
    return F.when(F.col(shard_id) == 0, F.lit("val")).otherwise(F.lit("train"))


def with_shard_names(df: DataFrame, shard_col: str = "shard_id") -> DataFrame:
    """Split label (shard 0 is val) and file name / stem."""
    split = shard_split(shard_col)
    return df.withColumn("split", split) \
        .withColumn("shard_name", F.format_string(SHARD_NAME_FORMAT, split, F.col(shard_col))) \
        .withColumn("shard_stem", F.format_string(SHARD_STEM_FORMAT, split, F.col(shard_col)))


def shard_stats(pieces: DataFrame) -> DataFrame:
    """Tokens, documents started and pieces per shard."""
    agg = pieces.groupBy("shard_id").agg(
        F.sum("piece_len").cast("long").alias("n_tokens"),
        F.count_if(F.col("doc_start") == 0).cast("long").alias("n_docs"),
        F.count(F.lit(1)).cast("long").alias("n_pieces"),
    )
    return with_shard_names(agg).select("shard_id", "split", "shard_name", "n_tokens", "n_docs", "n_pieces")


def corpus_offsets(corpus: DataFrame, encoder: str | Callable = "byte") -> DataFrame:
    return document_offsets(document_lengths(corpus, encoder))


def document_parts(shard_size: int, chunk_size: int) -> "F.Column":
    """Array of a document's parts, one per chunk it touches: ``(shard_id, chunk_id, pos, part)``."""
    S, C = F.lit(shard_size).cast("long"), F.lit(chunk_size).cast("long")
    off, end = F.col("doc_offset"), F.col("doc_offset") + F.col("n_tokens")

    def in_shard(shard):
        base = shard * S
        low, high = F.greatest(off, base) - base, F.least(end, base + S) - base  # positions in the shard

        def in_chunk(chunk):
            a, b = F.greatest(low, chunk * C), F.least(high, (chunk + 1) * C)
            return F.struct(shard.alias("shard_id"), chunk.cast("int").alias("chunk_id"), a.alias("pos"), F.slice(
                "tokens", (base + a - off + 1).cast("int"), (b - a).cast("int")).alias("part"))

        return F.transform(F.sequence(F.floor(low / C).cast("long"), F.floor((high - 1) / C).cast("long")), in_chunk)

    shards = F.sequence(F.floor(off / S).cast("long"), F.floor((end - 1) / S).cast("long"))
    return F.flatten(F.transform(shards, in_shard))


def packed_parts(corpus: DataFrame, shard_size: int, encoder: str | Callable = "byte") -> DataFrame:
    """``(shard_id, shard_stem, start_pos, packed)``: each document's part of each shard, ids as 16-bit bytes.

    Offsets come from a pass over the lengths alone and meet the texts, which are packed
    after that.  The only exchange that moves tokens is the one that brings a shard's parts
    together, at two bytes a token.
    """
    offsets = corpus_offsets(corpus, encoder).select("doc_ord", "n_tokens", "doc_offset")
    placed = corpus.select("doc_ord", "text").join(offsets, "doc_ord")
    pieces = shard_pieces(pack_documents(placed, encoder), shard_size)
    part = F.substring(F.col("packed"), (2 * F.col("doc_start") + 1).cast("int"), (2 * F.col("piece_len")).cast("int"))
    return with_shard_names(pieces.select(
        F.col("shard_id").cast("int").alias("shard_id"), F.col("shard_pos").alias("start_pos"), part.alias("packed"))).select(
        "shard_id", "shard_stem", "start_pos", "packed")


def pack_documents(corpus: DataFrame, encoder: str | Callable = "byte") -> DataFrame:
    """``corpus`` with ``packed`` in place of ``text``: delimiter and tokens of a document as little-endian 16-bit bytes."""
    kept = [f for f in corpus.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def pack(text: str) -> bytes:
        ids = np.array(encoder(text), np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= TOKEN_LIMIT):
            raise ValueError(f"ids from {ids.min()} to {ids.max()}; a shard stores 16 bits each")
        return np.append(BOS_ID, ids).astype("<u2").tobytes()

    def packed(rel: np.ndarray, raw: np.ndarray) -> pa.Array:
        if encoder == "byte":
            if 2 * (len(raw) + len(rel)) > np.iinfo(np.int32).max:
                raise ValueError(f"a text of {len(raw)} tokens; an Arrow value holds {np.iinfo(np.int32).max} bytes")
            tokens = np.insert(raw.astype("<u2"), rel[:-1], BOS_ID)
            bounds = (2 * (rel + np.arange(len(rel)))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(rel) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(tokens)])
        return pa.array([pack(raw[a:b].tobytes().decode()) for a, b in zip(rel, rel[1:])], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, rel, raw in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in names), packed(rel, raw)],
                                                 names=[*names, "packed"])

    return corpus.mapInArrow(run, T.StructType([*kept, T.StructField("packed", T.BinaryType())]))


def token_chunks(corpus: DataFrame, shard_size: int, chunk_size: int = CHUNK_SIZE,
                 encoder: str | Callable = "byte") -> DataFrame:
    """Managed shard storage: ``(shard_id, shard_stem, chunk_id, start_pos, tokens)``.

    Text travels through the offset shuffle (compact), tokens are made once per
    document after it, and only the final exchange by ``(shard_id, chunk_id)``
    moves token arrays.  A chunk holds at most ``chunk_size`` tokens, so every
    group is bounded whatever the document lengths.
    """
    offs = corpus_offsets(corpus, encoder)
    if "tokens" not in offs.columns:
        offs = byte_tokenize_frame(offs) if encoder == "byte" else \
            offs.withColumn("tokens", encode_document(F.col("text"), encoder))
    # cut the parts first, then explode them: no row carries its whole document once per chunk
    sub = offs.select(F.explode(document_parts(shard_size, chunk_size)).alias("part")).select("part.*")
    chunks = sub.groupBy("shard_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    chunks = chunks.select(
        F.col("shard_id").cast("int").alias("shard_id"), "chunk_id",
        (F.col("chunk_id").cast("long") * chunk_size).alias("start_pos"),
        F.flatten(F.transform("parts", lambda x: x["part"])).alias("tokens"),
    )
    return with_shard_names(chunks).select("shard_id", "shard_stem", "chunk_id", "start_pos", "tokens")
