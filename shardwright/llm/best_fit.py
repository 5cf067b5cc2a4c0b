"""Best-fit packing of token documents: bounded-space online best fit.

Documents are tokenised where they lie; only small rows (document, piece,
length, checksum of the ids) travel.  Pieces are dealt by a hash of their
document to packing streams, each of which is read once, in a fixed order,
with a fixed number of open bins.  The open bins' free spaces are the set bits
of one integer; the best fit is the lowest set bit at or above the piece's
length.  When a new bin would exceed the bound, the fullest open bin closes.
A stream arrives longest piece first (Spark sorts it), which leaves hardly any
space; its memory is that of the open bins.  Order and bins do not depend on
scheduling, so a task that is run again packs alike.

Nulls: a null text is empty, its document is the end id alone; null ids are
kept.  Repeated rows are packed as separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage
from .token_ids import encoder, text_slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PIECES_PER_STREAM = 100_000


def pieces_of(raw: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; only the first may be short of ``capacity``."""
    n = len(raw) // 4
    head = n % capacity or min(n, capacity)
    cuts = [0, *range(head, n + 1, capacity)] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(raw[4 * a:4 * b])) for a, b in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of a document, tokenised whole."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts, ids, rows = (batch.column(k).to_pylist() for k in ("text", "doc_id", "row"))
            for a, b in text_slices(texts):
                out: list[tuple] = []
                for doc, row, raw in zip(ids[a:b], rows[a:b], enc.encode_all(texts[a:b])):
                    out.extend((doc, k, s, n, c, row) for k, (s, n, c) in enumerate(pieces_of(raw + end, capacity)))
                doc, k, s, n, c, row = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(row, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.mapInArrow(run, PIECE_SCHEMA)


class OpenBins:
    """At most ``most`` open bins of ``capacity``, found by the free space they have."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n_open, self.n_bins = capacity, most, 0, 0
        self.free_bits = 0  # bit f: some open bin has f free places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Place a piece; gives (bin, offset)."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.most:  # close the fullest
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return number


def pack(pieces: DataFrame, capacity: int, open_bins: int, n_streams: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; each stream packs its pieces online."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            places = [bins.put(n) for n in batch.column("length").to_pylist()]
            at = np.array(places, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])],
                names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(n_streams, F.xxhash64("doc_id", "row", "piece")).sortWithinPartitions(
        F.desc("length"), "row", "piece")
    return dealt.mapInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def best_fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
             capacity: int = 1024, open_bins: int = 16_384) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece."""
    numbered = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"))
    pieces = stage(token_pieces(numbered, vocabulary, end_id, capacity), "pieces")
    n_streams = -(-max(1, pieces.count()) // PIECES_PER_STREAM)
    return pack(pieces, capacity, open_bins, n_streams).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
