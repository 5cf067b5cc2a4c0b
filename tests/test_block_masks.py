"""Block-mask ranges against all pairs of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from shardwright.operators import spans as sp

KEYS = ["slice_no"]


@pytest.fixture(scope="module")
def cases():
    """Per slice: its number of tokens and where its documents start (tokens before the first belong to none)."""
    rnd = random.Random(6)
    return {s: (n, sorted(rnd.sample(range(n), rnd.randrange(min(n, 12))))) for s, n in enumerate(rnd.randrange(8, 90) for _ in range(40))}


@pytest.fixture(scope="module")
def runs(spark, cases):
    rows = []
    for s, (n, starts) in cases.items():
        edges = [0, *[x for x in starts if x], n]
        first = 1 if starts[:1] == [0] else 0
        rows += [(s, first + k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "slice_no int, doc_id long, run_start long, run_end long")


def plain(n, starts, block):
    ids = [sum(x <= t for x in starts) for t in range(n)]
    docs = [(min(ids[k:k + block]), max(ids[k:k + block])) for k in range(0, n, block)]
    for q, (low, high) in enumerate(docs):
        needed = [k for k in range(q, -1, -1) if docs[k][1] >= low]
        full = [k for k in needed if k < q and low == high and docs[k] == (low, low)]
        yield q, full, [k for k in needed if k not in full]


@pytest.mark.parametrize("block", [1, 4, 7])
def test_lists(runs, cases, block):
    ranges = sp.block_mask_ranges(runs, KEYS, block)
    got = {(r["slice_no"], r["q_blk"]): (r["full_kv"], r["partial_kv"]) for r in sp.block_mask_lists(ranges, KEYS).collect()}
    assert got == {(s, q): (f, p) for s, (n, starts) in cases.items() for q, f, p in plain(n, starts, block)}
    for w in (1, 2, 5):
        near = sp.block_mask_lists(ranges, KEYS, window_blocks=w).collect()
        assert {(r["slice_no"], r["q_blk"]): (r["full_kv"], r["partial_kv"]) for r in near} == {
            (s, q): ([k for k in f if q - k < w], [k for k in p if q - k < w]) for (s, q), (f, p) in got.items()}
        capped = sp.block_mask_lists(ranges, KEYS, cap_blocks=w).collect()
        assert {(r["slice_no"], r["q_blk"]): (r["full_kv"], r["partial_kv"]) for r in capped} == {
            key: (f[:w - 1], p[:max(w - len(f[:w - 1]), 1)]) for key, (f, p) in got.items()}


def test_counts_agree_with_the_pairs(runs):
    blocks = sp.block_doc_ranges(runs, KEYS, 4)
    pairs = sp.block_mask_counts(sp.block_pairs(blocks, KEYS), KEYS)
    lists = sp.block_mask_lists(sp.block_mask_ranges(runs, KEYS, 4), KEYS).select(
        *KEYS, "q_blk", F.size("full_kv").cast("long").alias("n_full"), F.size("partial_kv").cast("long").alias("n_partial"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, lists.collect()))
