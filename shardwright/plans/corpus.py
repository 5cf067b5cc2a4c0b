"""Shared derived tables of the registered queries (built from ``documents``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import spans as sp
from ..operators import tokens as tk
from ..session import scratch_path
from ..sources import files
from ..sources import token_bin as tb
from ..sources.tables import read_corpus
from .params import CHUNK_SIZE, SHARD_SIZE


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.shard_pieces(tk.corpus_offsets(read_corpus(spark, sf_dir)), SHARD_SIZE)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed shard storage of the corpus (token chunks)."""
    return tk.token_chunks(read_corpus(spark, sf_dir), SHARD_SIZE, CHUNK_SIZE)


def shard_files(spark: SparkSession, sf_dir: str) -> str:
    """The corpus written as shard files into a fresh shared folder; it goes when the driver's JVM ends."""
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    tb.write_shards(tk.packed_parts(read_corpus(spark, sf_dir), SHARD_SIZE), path)
    files.delete_on_exit(spark, path)
    return path


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(delimiters, shard sizes, training spans) from the piece table."""
    p = pieces(spark, sf_dir)
    delims = sp.delimiters_from_pieces(p)
    sizes = sp.shard_sizes_from_pieces(p)
    return delims, sizes, sp.train_spans(delims, sizes)
