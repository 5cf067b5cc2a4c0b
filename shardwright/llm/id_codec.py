"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block is coded on its own: its models start empty and its bytes can be read
without any other block.  Order-2 and order-1 contexts each predict one id (the
last one that followed them, with a confidence).  A flag says whether the
longer available prediction is right; its probability is a mix, with adaptive
weights, of three adaptive estimates (order 0: how often predictions hit at
all; order 1 and order 2: how often with these confidences).  An id that was
not predicted is coded by the order-0 model, adaptive frequencies of its upper
part, and its lower byte.  All arithmetic is on integers, so encoder and
decoder agree on every machine.

The coder steps through equally long blocks in lockstep, one numpy operation
for all of them, so the cost of Python is shared by all blocks of a call.
"""

from __future__ import annotations

import numpy as np

SLOT_BITS = 9
CHANCE_BITS = 12
STATE_BITS = 48  # a value of so many bits is exact in double precision, and so is its quotient rounded down
TOP = 1 << 32
KEEP = TOP - 1
FULL = (1 << STATE_BITS) - 1
CUM_BITS = 16
REBUILD = 64
GAIN = 24
PADDING = 40  # between rows of digits: no power of two apart
START_CHANCE = 1200
LAST_CUM = (1 << CUM_BITS) - 1


def filled(n: int, value: int, dtype: type) -> np.ndarray:
    """Written at once, which lets the system back a large array by large pages."""
    out = np.empty(n, dtype)
    out.fill(value)
    return out


class Models:
    """Models of ``lanes`` blocks for ids below ``n_ids``; everything about a block is in its own rows."""

    def __init__(self, lanes: int, n_ids: int):
        self.lanes = lanes
        rows = np.arange(lanes, dtype=np.int64)
        self.n_upper = (n_ids + 255) >> 8
        if self.n_upper > 1 << (CUM_BITS - 2):
            raise ValueError(f"ids must be below {1 << (CUM_BITS + 6)}, not {n_ids}")
        # a slot holds the predicted id and, in its last two bits, the confidence; 0 is empty
        self.slots = rows << SLOT_BITS
        self.order1, self.order2 = (filled(lanes << SLOT_BITS, 0, np.int32) for _ in range(2))
        self.hit0 = np.full(lanes, START_CHANCE, np.int32)
        self.hit1, self.hit2 = (np.full(lanes * n, START_CHANCE, np.int32) for n in (8, 16))
        self.rows8, self.rows16 = rows * 8, rows * 16
        self.w1, self.w2 = (np.full(lanes, 160, np.int32) for _ in range(2))
        self.counts = np.ones((lanes, self.n_upper), np.int32)
        self.upper_rows, self.coded = rows * self.n_upper, []
        # a row of frequencies ends in the highest value, for a binary search without bounds; the search
        # looks at every 16th first, in a small table.  Rows are no power of two apart, which caches dislike
        self.fine = min(4, self.n_upper.bit_length())
        self.rough = self.n_upper.bit_length() - self.fine
        width = (1 << self.rough + self.fine) + 18
        self.cum = filled(lanes * width, LAST_CUM, np.uint16)
        self.own_cum, self.cum_rows = self.cum.reshape(lanes, width)[:, :self.n_upper + 1], rows * width
        self.own_cum[:, 0] = 0
        self.rough_rows = rows * ((1 << self.rough) + 1)
        self.rough_cum = np.full(lanes * ((1 << self.rough) + 1), LAST_CUM, np.uint16)
        self.symbols = np.arange(1, self.n_upper + 1, dtype=np.float32)
        self.step, self.last, self.mixed_last = 0, np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def rebuild(self) -> None:
        """Cumulative order-0 frequencies, scaled to 2 ** CUM_BITS, every symbol at least 1."""
        if self.coded:
            again = np.bincount(np.concatenate(self.coded), minlength=self.counts.size)
            self.counts += again.reshape(self.counts.shape).astype(np.int32) * np.int32(GAIN)
            self.coded.clear()
        run = np.cumsum(self.counts, axis=1, dtype=np.int32)
        # sums are exact in single precision; a quotient, a product and a sum are rounded alike everywhere
        scale = np.float32(LAST_CUM - self.n_upper) / run[:, -1:].astype(np.float32)
        scaled = run * scale
        np.floor(scaled, out=scaled)
        scaled += self.symbols
        self.own_cum[:, 1:] = scaled
        some = self.own_cum[:, ::1 << self.fine]
        self.rough_cum.reshape(self.lanes, -1)[:, :some.shape[1]] = some

    def find(self, blocks: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Places in ``cum`` of the last frequencies at or below ``top``, by binary search."""
        at = self.rough_rows[blocks]
        base = at.copy()
        for k in range(self.rough - 1, -1, -1):
            at += (self.rough_cum[at + (1 << k)] <= top).astype(np.int64) << k
        at = (at - base << self.fine) + self.cum_rows[blocks]
        for k in range(self.fine - 1, -1, -1):
            at += (self.cum[at + (1 << k)] <= top).astype(np.int64) << k
        return at

    def predict(self) -> None:
        """Prediction of the next id and the chance, of 2 ** CHANCE_BITS, that it is right."""
        if self.step % REBUILD == 0:
            self.rebuild()
        mask, product = (1 << SLOT_BITS) - 1, self.last * 40503
        self.mixed_last += product
        self.at1 = ((product >> 5) & mask) + self.slots
        self.at2 = ((self.mixed_last >> 7) & mask) + self.slots
        self.mixed_last = self.last * 50021
        x1, x2 = self.x1, self.x2 = self.order1[self.at1], self.order2[self.at2]
        self.c1, self.c2 = x1 & 3, x2 & 3
        none2 = x2 == 0
        chosen = x1 * none2 + x2
        self.guess, self.able = chosen >> 2, chosen > 0
        self.i1 = self.rows8 + (self.c1 + (np.minimum(self.c2, 1) << 2))
        self.i2 = self.rows16 + (self.c1 + (self.c2 << 2))
        self.e1, self.e2 = self.hit1[self.i1], self.hit2[self.i2]
        mixed = (self.w1 * (self.e1 - self.hit0) + self.w2 * (self.e2 - self.hit0) >> 9) + self.hit0
        self.chance = np.minimum(np.maximum(mixed, 32), (1 << CHANCE_BITS) - 32)

    def learn(self, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray, upper: np.ndarray) -> None:
        """``missed``: numbers of the blocks whose id was coded by order 0; ``upper``: the upper parts of these ids."""
        goal = hit.astype(np.int32) << CHANCE_BITS
        if self.step % 4 == 0:  # the better estimate of the two gains weight
            off = np.abs(goal - self.chance)
            for estimate, weight in ((self.e1, self.w1), (self.e2, self.w2)):
                weight += (np.abs(goal - estimate) < off) * np.int32(9) - np.int32(4)
                np.minimum(np.maximum(weight, 1, out=weight), 254, out=weight)
        self.hit0 += (goal - self.hit0) >> 6
        self.hit1[self.i1] = self.e1 + ((goal - self.e1) >> 5)
        self.hit2[self.i2] = self.e2 + ((goal - self.e2) >> 4)
        fresh = (ids << 2) + 1
        self.order1[self.at1] = fresh + ((self.x1 >> 2) == ids) * np.minimum(self.c1, 2)
        self.order2[self.at2] = fresh + ((self.x2 >> 2) == ids) * np.minimum(self.c2, 2)
        self.coded.append(self.upper_rows[missed] + upper)
        self.last, self.step = ids.astype(np.int64), self.step + 1


def encode_blocks(ids: np.ndarray, n_ids: int) -> list[bytes]:
    """Bytes of equally long blocks, the rows of ``ids``."""
    lanes, length = ids.shape
    model, columns = Models(lanes, n_ids), np.ascontiguousarray(ids.T.astype(np.int32))
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, FULL, np.int64)
    row = lanes + PADDING
    digits = np.zeros((3 * length + 8, row), np.uint32)  # 16 bits and a carry each, those of a block in a column
    flat, columns_of = digits.reshape(-1), np.arange(lanes, dtype=np.int64)
    at_digit = columns_of.copy()

    for t in range(length):
        model.predict()
        now, able = columns[t], model.able
        hit = able & (model.guess == now)
        bound = (rng >> CHANCE_BITS) * model.chance
        cut = bound * (able ^ hit)
        low += cut
        rng -= cut
        rng += (bound - rng) * hit
        missed = np.flatnonzero(~hit)
        symbol = now[missed]
        upper = symbol >> 8
        at = model.cum_rows[missed] + upper
        start = model.cum[at].astype(np.int64)
        share = model.cum[at + 1] - start
        r = rng[missed] >> (CUM_BITS + 8)
        low[missed] += r * ((start << 8) + (symbol & 255) * share)
        rng[missed] = r * share
        # one digit of every block that has one ready, written by all and kept by these; then the few with more
        ready = rng < TOP
        out = low >> 32
        flat[at_digit] = out
        ready = ready.astype(np.int64)
        at_digit += ready * row
        low -= (out << 32) * ready
        ready <<= 4
        low <<= ready
        rng <<= ready
        m = np.flatnonzero(rng < TOP)
        while len(m):
            out = low[m]
            flat[at_digit[m]] = out >> 32
            at_digit[m] += row
            low[m] = (out & KEEP) << 16
            left = rng[m] << 16
            rng[m] = left
            m = m[left < TOP]
        model.learn(now, hit, missed, upper)
    for _ in range(3):
        flat[at_digit] = low >> 32
        at_digit += row
        low = (low & KEEP) << 16
    n_digits = (at_digit - columns_of) // row
    digits = digits[:n_digits.max(), :lanes]
    digits[np.arange(len(digits))[:, None] >= n_digits] = 0
    for k in range(len(digits) - 1, 0, -1):  # carries run towards the front
        digits[k - 1] += digits[k] >> 16
    out = np.ascontiguousarray(digits.astype(np.uint16).T).astype(">u2")
    return [out[k, :n].tobytes() for k, n in enumerate(n_digits.tolist())]


def decode_blocks(payloads: list[bytes], length: int, n_ids: int) -> np.ndarray:
    """The ids of equally long blocks, one block a row."""
    lanes = len(payloads)
    model = Models(lanes, n_ids)
    head = STATE_BITS // 8
    width = max(len(p) for p in payloads) // 2 + 1
    digits = np.zeros((lanes, width), np.uint16)
    for k, p in enumerate(payloads):
        rest = p[head:] + b"\0" * (len(p) - head & 1)
        digits[k, :len(rest) // 2] = np.frombuffer(rest, ">u2")
    # those of a block in a column; damaged blocks may ask for more than there is
    row = lanes + PADDING
    flat = np.zeros((width + 3 * length + 8, row), np.uint16)
    flat[:width, :lanes] = digits.T
    flat = flat.reshape(-1)
    at_digit = np.arange(lanes, dtype=np.int64)
    value = np.array([int.from_bytes(p[:head], "big") for p in payloads], np.int64)
    rng = np.full(lanes, FULL, np.int64)
    columns = np.zeros((length, lanes), np.uint32)
    for t in range(length):
        model.predict()
        bound = (rng >> CHANCE_BITS) * model.chance
        hit = model.able & (value < bound)
        cut = bound * (model.able ^ hit)
        value -= cut
        rng -= cut
        rng += (bound - rng) * hit
        now = model.guess
        missed = np.flatnonzero(~hit)
        r, held = rng[missed] >> (CUM_BITS + 8), value[missed]
        v = (held / r).astype(np.int64)
        base, top = model.cum_rows[missed], v >> 8
        at = model.find(missed, top.astype(np.uint16))
        at = np.minimum(at, base + (model.n_upper - 1))  # beyond it only where a block is damaged
        start = model.cum[at].astype(np.int64)
        share = model.cum[at + 1] - start
        upper = at - base
        lower = ((v - (start << 8)) / share).astype(np.int64)
        now[missed] = (upper << 8) + lower
        value[missed] = held - r * ((start << 8) + lower * share)
        rng[missed] = r * share
        ready = rng < TOP
        more = flat[at_digit] * ready
        ready = ready.astype(np.int64)
        at_digit += ready * row
        ready <<= 4
        value <<= ready
        value += more
        rng <<= ready
        m = np.flatnonzero(rng < TOP)
        while len(m):
            value[m] = (value[m] << 16) | flat[at_digit[m]]
            at_digit[m] += row
            left = rng[m] << 16
            rng[m] = left
            m = m[left < TOP]
        columns[t] = now
        model.learn(now, hit, missed, upper)
    return np.ascontiguousarray(columns.T)
