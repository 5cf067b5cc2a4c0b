"""Alignment of two tokenizers' tokens by their bytes, with corpus-wide counts of the linked ids.

A text is encoded twice, by a byte-level BPE file (A, of a blank and the text) and a
SentencePiece file (B, which adds the blank itself); every token stands for a run of
bytes.  Where an A and a B token end at the same byte the two are linked and cut the
text into groups.

*Merging in lockstep.*  All documents of a block advance together: one vector holds
the A pointers, one the B pointers.  Every step compares the ends both point at, emits
links and cuts where they are equal, moves the pointer of the end that comes first (both
where equal) and drops the documents that are through.  Whether two ends meet depends
on nothing before them, so a long document goes as several lanes of ``LANE_BYTES``
bytes, and no document makes the others wait.

*Counts.*  A block's links are counted by pair of ids in its task.  Spark adds the
blocks' counts up and finds every B id's highest; each block asks for its own
distinct pairs, whatever documents they are in, and its documents' sums are taken when the
answers meet the block's documents again.  A block holds about ``BLOCK_CHARS``
characters or one longer document.

Results for odd input: a null or empty text, and one whose tokens' joined bytes are
not the blank and the text (a text with U+2581, say), has no tokens: zeros, and the
empty string for the groups.  Strings of special tokens are plain text.  Null ids are
kept, repeated rows are aligned one by one and count as often.  An empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage
from .token_ids import WordEncoder

LANE_BYTES = 2048
BLOCK_CHARS = 2_000_000
MOST_WORDS = 300_000  # of the A encoder's cache
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, cut_bytes array<int>"
COUNTED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "codes array<int>, times array<int>, pairs array<long>, pair_times array<long>")
SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = WordEncoder(a_path, MOST_WORDS)
        self.a.tok.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as lines:
            spec = json.load(lines)
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        byte = byte_of_character()
        entries = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added} | added
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_lengths = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(t) for t in self.b_bytes], np.int64)
        # text of a token in the groups' string: with a comma, or with what ends its side of a group
        self.words = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(pieces), ",;")) for i in range(n) for end in ends]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and B; of texts without tokens none."""
        full = [t for t in texts if t]
        # the letter before the blank is a word of its own, taken off again
        a_ids = [np.frombuffer(raw, "<u4").astype(np.int64)[1:] for raw in self.a.encode_all(["x " + t for t in full])]
        b_ids = [np.array(ids, np.int64) for ids in self.b.encode(full, num_threads=1)] if full else []
        none, of_a, of_b = np.empty(0, np.int64), [], []
        coded = iter(zip(full, a_ids, b_ids))
        for text in texts:
            if text:
                _, a, b = next(coded)
                whole = (" " + text).encode()
                if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or \
                        b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
                    a = b = none
            else:
                a = b = none
            of_a.append(a)
            of_b.append(b)
        return of_a, of_b


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and B that end together, as two masks.

    Ends count bytes through all documents of the block; ``stops`` are the last bytes of
    the lanes, which follow each other.
    """
    i_stop, j_stop = np.searchsorted(a_ends, stops, "right"), np.searchsorted(b_ends, stops, "right")
    i, j = np.concatenate(([0], i_stop[:-1])), np.concatenate(([0], j_stop[:-1]))
    a_linked, b_linked = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    live = np.flatnonzero((i < i_stop) & (j < j_stop))
    while len(live):
        if len(live) < len(i):
            i, j, i_stop, j_stop = i[live], j[live], i_stop[live], j_stop[live]
        a, b = a_ends[i], b_ends[j]
        same = a == b
        a_linked[i[same]] = True
        b_linked[j[same]] = True
        i, j = i + (a <= b), j + (b <= a)
        live = np.flatnonzero((i < i_stop) & (j < j_stop))
    return a_linked, b_linked


@dataclass
class Block:
    """Aligned documents, their tokens one after the other."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_from: np.ndarray  # first token of each document, and the end of the last
    b_from: np.ndarray
    a_cut: np.ndarray  # the linked tokens, pair by pair: each is the last one of its group
    b_cut: np.ndarray
    cut_bytes: np.ndarray  # where they end, from the start of the document
    cut_from: np.ndarray  # first group of each document


def align_block(tokenizers: Tokenizers, texts: list[str]) -> Block:
    of_a, of_b = tokenizers.encode(texts)
    a_from, b_from = (np.concatenate(([0], np.cumsum([len(x) for x in side]))) for side in (of_a, of_b))
    a_ids, b_ids = (np.concatenate([*side, np.empty(0, np.int64)]) for side in (of_a, of_b))
    a_ends, b_ends = np.cumsum(tokenizers.a_lengths[a_ids]), np.cumsum(tokenizers.b_lengths[b_ids])
    starts = np.concatenate(([0], a_ends))[a_from]  # bytes before each document
    sizes = np.diff(starts)
    lanes = -(-sizes // LANE_BYTES)
    first = np.repeat(np.cumsum(lanes) - lanes, lanes)
    nth = np.arange(len(first)) - first + 1
    stops = np.repeat(starts[:-1], lanes) + np.minimum(nth * LANE_BYTES, np.repeat(sizes, lanes))
    a_linked, b_linked = lockstep(a_ends, b_ends, stops)
    a_cut, b_cut = np.flatnonzero(a_linked), np.flatnonzero(b_linked)
    cut_from = np.searchsorted(a_cut, a_from)
    cut_bytes = a_ends[a_cut] - np.repeat(starts[:-1], np.diff(cut_from))
    return Block(a_ids, b_ids, a_from, b_from, a_cut, b_cut, cut_bytes, cut_from)


def groups_text(tokenizers: Tokenizers, block: Block) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document: decimal ids, group by group."""
    n_a, n_b = len(block.a_ids), len(block.b_ids)
    a_last, b_last = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    a_last[block.a_cut] = 1
    b_last[block.b_cut] = 1
    words = np.empty(n_a + n_b, np.int64)
    # before a token stand its own side's tokens and the other side's of all groups before it (A comes first in its own)
    b_before = np.concatenate(([0], block.b_cut + 1))[np.cumsum(a_last) - a_last]
    a_before = (block.a_cut + 1)[np.cumsum(b_last) - b_last]
    words[np.arange(n_a) + b_before] = 2 * block.a_ids + a_last
    words[np.arange(n_b) + a_before] = 2 * len(tokenizers.a_bytes) + 2 * block.b_ids + b_last
    written = list(map(tokenizers.words.__getitem__, words.tolist()))
    ends = (block.a_from + block.b_from).tolist()
    return ["".join(written[s:e])[:-1] for s, e in zip(ends, ends[1:])]


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    """The worker's pair of tokenizers, kept from task to task."""
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def blocks(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``most_chars`` characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= most_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id",
          text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_cuts, b_cuts, cut_bytes``: the links ``(a_cuts[k], b_cuts[k])``, by token number, and their byte."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(*paths)
        for ids, texts in blocks(batches, block_chars):
            x = align_block(both, texts)
            n = np.diff(x.cut_from)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), lists(x.a_ids, x.a_from, pa.int32()), lists(x.b_ids, x.b_from, pa.int32()),
                lists(x.a_cut - np.repeat(x.a_from[:-1], n), x.cut_from, pa.int32()),
                lists(x.b_cut - np.repeat(x.b_from[:-1], n), x.cut_from, pa.int32()),
                lists(x.cut_bytes, x.cut_from, pa.int32())],
                names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "cut_bytes"])

    return _texts(docs, id_col, text_col).mapInArrow(run, ALIGNED)


def counted_links(docs: DataFrame, paths: tuple[str, str], block_chars: int) -> DataFrame:
    """Documents with their distinct links (codes into the block's pairs); the first of a block also has those pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers_of(*paths), TaskContext.get().partitionId() << 32
        for ids, texts in blocks(batches, block_chars):
            x = align_block(both, texts)
            written = groups_text(both, x)
            pairs, codes = np.unique(x.a_ids[x.a_cut] * len(both.b_bytes) + x.b_ids[x.b_cut], return_inverse=True)
            n_links, width = np.diff(x.cut_from), max(1, len(pairs))
            own, times = np.unique(np.repeat(np.arange(len(ids)), n_links) * width + codes, return_counts=True)
            bounds = np.searchsorted(own, np.arange(len(ids) + 1) * width)
            first = np.array([0] + [len(pairs)] * len(ids))
            none = np.arange(len(ids)) > 0
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * len(ids), pa.int64()), pa.array(ids, pa.int64()),
                pa.array(np.diff(x.a_from)), pa.array(np.diff(x.b_from)), pa.array(n_links), pa.array(n_links),
                pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in written], pa.string()),
                lists(own % width, bounds, pa.int32()), lists(times, bounds, pa.int32()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(pairs, pa.int64()), mask=pa.array(none)),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.bincount(codes, minlength=len(pairs)), pa.int64()),
                                         mask=pa.array(none))],
                names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "pairs", "pair_times"])
            number += 1

    return docs.mapInArrow(run, COUNTED)


def score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents, from the answers to its pairs."""
    n = answers.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    code = answers.column("code").to_numpy()
    count[code], best[code] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    own, times = (docs.column(c).combine_chunks() for c in ("codes", "times"))
    bounds, codes, times = own.offsets.to_numpy(), own.values.to_numpy(), times.values.to_numpy().astype(np.int64)

    def sums(values: np.ndarray) -> pa.Array:
        running = np.concatenate(([0], np.cumsum(values)))
        return pa.array(running[bounds[1:]] - running[bounds[:-1]])

    table = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    table = table.append_column("n_best", sums(times * best[codes])).append_column("count_sum", sums(times * count[codes]))
    return table.append_column("groups_sha256", docs.column("groups_sha256"))


def align_and_count(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs``."""
    paths = _paths(a_path, b_path)
    n_b_ids = b_size(paths[1])
    linked = stage(counted_links(_texts(docs, id_col, text_col), paths, block_chars), "linked")
    asked = linked.filter("pairs IS NOT NULL").select(
        "block", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("code", "x")).select(
        "block", "code", F.col("x.pairs").alias("pair"), F.col("x.pair_times").alias("n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    # a B id meets at most the ids of A, so its window is bounded by that vocabulary
    highest = F.max("count").over(Window.partitionBy(F.col("pair") % n_b_ids))
    counts = counts.select("pair", "count", (F.col("count") == highest).alias("best"))
    answers = asked.select("block", "code", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "code", "count", "best")
    rows = linked.drop("pairs", "pair_times")
    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(score_block, SCORED)


def b_size(path: str) -> int:
    """Number of ids of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
