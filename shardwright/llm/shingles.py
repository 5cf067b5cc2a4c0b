"""Sets of hashed five-word shingles of whole texts, a batch at a time in numpy.

Words are runs of bytes other than ``\\x20\\x09-\\x0D`` after A-Z are lower-cased.
A word's hash is a polynomial over random 64-bit byte values, read off one
running sum over the batch; a shingle's hash combines its words' hashes by
position.  A text of one to four words is one shingle of that many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE_BYTES = 600_000
_rng = np.random.default_rng(20240501)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUES[ord("A"):ord("Z") + 1] = BYTE_VALUES[ord("a"):ord("z") + 1]
PLACES = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``SLICE_BYTES``."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(raw):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def hashed_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and how many each text has."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    inside = ~IS_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = False
    after[offsets[filled + 1] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(max(len(data) + 1, SLICE_BYTES))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:len(data)], out=run[1:])
    words = mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    of_text = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(of_text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(n_words)))
    sums = words * PLACES[0]
    # a shingle of k words starts wherever k - 1 more words of the text follow
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    for k in range(1, WIDTH):
        take = np.minimum(k, np.maximum(n_words[of_text] - 1, 0)) >= k
        sums += padded[k:k + len(words)] * PLACES[k] * take
    place = np.arange(len(words)) - first[of_text]
    n_shingles = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    whole = place < n_shingles[of_text]
    seed = np.minimum(n_words, WIDTH)[of_text].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(sums + seed)[whole], n_shingles


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every row."""
    for row, data, offsets in slices(texts):
        hashes, counts = hashed_shingles(data, offsets)
        stops = np.cumsum(counts)
        for k, (a, b) in enumerate(zip((stops - counts).tolist(), stops.tolist())):
            own = np.sort(hashes[a:b])
            if b - a > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield row + k, own


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set of hashes."""
    if not len(hashes):
        return 0, 0
    both = np.array([mixed(hashes).sum(dtype=np.uint64), mixed(hashes ^ np.uint64(FACTOR)).sum(dtype=np.uint64)])
    one, two = both.view(np.int64).tolist()
    return one, two
