"""Byte-level BPE as a finite-state transducer, and streaming decoding.

*Encoding.*  A sequence of tokens is the BPE encoding of its bytes exactly if
every token is the encoding of its own bytes and every two neighbours are the
encoding of theirs.  Read as an automaton that is nondeterministic: after some
bytes the last token may have ended at any of the last few places.  A state of
the determinised transducer is the set of these readings, each with the tokens
it has not yet agreed on with the others and the bytes of its unfinished token;
what all readings agree on is emitted, so the lookahead is bounded by the
longest token.  Exactly one reading has no unfinished token: it is what a match
that ends here emits.  States and transitions are worked out when the text first
needs them and kept in a hash table of arrays (state, byte -> next state, emission).

All matches of the splitting pattern of a slice of texts run through the tables
side by side: one vector of states, one look-up per byte position.  The matches
themselves are found on arrays of character classes, which are taken from
the tokenizer library once per worker.

*Decoding.*  ``StreamDecoder`` takes ids in any portions and gives text as soon
as its characters are complete; between portions it holds the state of a UTF-8
machine, which is the at most three bytes of an unfinished character.  Bytes that
are no UTF-8 become U+FFFD, one per maximal part, as in Python's own decoder.

Nulls: a null text is empty and has no tokens; null ids are kept, repeated rows
are coded one by one.  Texts of any length are coded whole, as one document among
those of a slice; the tables are dropped between slices once they exceed
``MOST_STATES``, which changes no result.  An empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import text_slices

MOST_STATES = 250_000
MOST_CACHED = 150_000
NEVER = 1 << 30
REPLACED = "\ufffd"  # stands for bytes that are no UTF-8
SCATTER = 0x9E3779B97F4A7  # odd, for hashing; products wrap
FEW_LANES = 12  # below so many unfinished matches a plain loop is cheaper than a vector step
SLICE_CHARS = 1_000_000
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
BREAK = "\ud800"  # between texts; no text holds a lone surrogate
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"


class Vocabulary:
    """Ranks of a byte-level BPE file, which are also the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.lowest: dict[bytes, int] = {}  # lowest rank of the tokens that start so
        for token, rank in self.ranks.items():
            for k in range(1, len(token) + 1):
                start = token[:k]
                if rank < self.lowest.get(start, NEVER):
                    self.lowest[start] = rank
        self.open = {t[:k] for t in self.ranks for k in range(1, len(t))}  # proper prefixes of tokens
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}  # of the UTF-8 machine: held bytes, id -> text, held bytes
        stepped = [utf8_step(b"", token) for token in self.bytes_of]
        self.characters = [None if held or REPLACED in text else text for text, held in stepped]
        self._whole: dict[int, bool] = {}
        self._edges: dict[int, list[tuple[bytes, int]]] = {}
        self._grown: dict[tuple[int, bytes], tuple[int | None, int | None]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves: again and again the leftmost pair of the lowest rank."""
        parts, ranks = [word[k:k + 1] for k in range(len(word))], self.ranks
        while len(parts) > 1:
            pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            low = min((r for r in pairs if r is not None), default=None)
            if low is None:
                break
            k = pairs.index(low)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if token not in self._whole:
            self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return self._whole[token]

    def right_edge(self, token: int) -> list[tuple[bytes, int]]:
        """The parts that end a token while it is merged, each with the rank of the merge that takes it in."""
        if token not in self._edges:
            word, edge = self.bytes_of[token], []
            parts, ranks = [word[k:k + 1] for k in range(len(word))], self.ranks
            while len(parts) > 1:
                pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                k = pairs.index(min(pairs))
                if k == len(pairs) - 1:
                    # a merge later than its parts is the rule; were it not, the part counts as never taken in
                    late = pairs[k] > max(ranks[parts[k]], ranks[parts[k + 1]])
                    edge.append((parts[-1], pairs[k] if late else NEVER))
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self._edges[token] = [*edge, (word, NEVER)]
        return self._edges[token]

    def touches(self, a: int, rest: bytes) -> bool:
        """Whether a merge across the end of ``a`` could come first, for some token that starts with ``rest``."""
        ranks, lowest = self.ranks, self.lowest
        for part, taken in self.right_edge(a):
            if lowest.get(part + rest, NEVER) < taken:
                return True
            for k in range(1, len(rest)):
                if ranks.get(part + rest[:k], NEVER) < taken:
                    return True
        return False

    def neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens in a row are the encoding of their bytes."""
        if not self.touches(a, self.bytes_of[b]):
            return True
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def grow(self, last: int, rest: bytes) -> tuple[int | None, int | None]:
        """What a reading becomes whose unfinished token is now ``rest``, after the token ``last`` (-1: any).

        The first value is the token before if ``rest`` can grow on, forgotten (-1) once no
        token that starts so can merge with it; the second the token that ends here.
        """
        key = (last, rest)
        if key not in self._grown:
            if len(self._grown) > MOST_CACHED:
                self._grown.clear()
            before = token = None
            if rest in self.open:
                before = last if last >= 0 and self.touches(last, rest) else -1
            if rest in self.ranks:
                token = self.ranks[rest]
                if not self.whole(token) or last >= 0 and not self.neighbours(last, token):
                    token = None
            self._grown[key] = before, token
        return self._grown[key]


class Transducer:
    """Lazily determinised; state 0 stands at the start of a match."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.readings: list[bytes] = []  # of every state, marshalled to save memory
        self.number: dict[bytes, int] = {}
        self.emission_number: dict[tuple[int, ...], int] = {}
        self.sizes, self.tokens = array("q"), array("q")  # of all emissions, one after the other
        self.end = array("q")
        self._emission(())
        self.keys = np.full(1 << 16, -1, np.int64)  # hashed by state and byte: next state, emission
        self.values = np.zeros((1 << 16, 2), np.int32)
        self.n_keys = 0
        self._state([((), -1, b"")])

    def _emission(self, tokens: tuple[int, ...]) -> int:
        if tokens not in self.emission_number:
            self.emission_number[tokens] = len(self.sizes)
            self.sizes.append(len(tokens))
            self.tokens.extend(tokens)
        return self.emission_number[tokens]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, or the free slots where they belong."""
        mask = len(self.keys) - 1
        slots = (keys * SCATTER >> 20) & mask
        held = self.keys[slots]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & mask
            held = self.keys[slots[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return slots

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add transitions whose keys are new and distinct."""
        self.n_keys += len(keys)
        if 2 * self.n_keys > len(self.keys):
            used = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate((self.keys[used], keys)), np.concatenate((self.values[used], values))
            room = 1 << (4 * self.n_keys).bit_length()
            self.keys, self.values = np.full(room, -1, np.int64), np.zeros((room, 2), np.int32)
        while len(keys):  # of the keys that want one slot the last gets it
            slots = self._find(keys)
            self.keys[slots] = keys
            got = self.keys[slots] == keys
            self.values[slots[got]] = values[got]
            keys, values = keys[~got], values[~got]

    def _state(self, readings: list[tuple]) -> int:
        """Number of a state; a reading is the tokens not agreed on, the token before the unfinished one, the latter's bytes."""
        packed = marshal.dumps(readings, 2)
        if packed not in self.number:
            self.number[packed] = len(self.readings)
            self.readings.append(packed)
            self.end.append(self._emission(next(tokens for tokens, _, rest in readings if not rest)))
        return self.number[packed]

    def resolve(self, keys: list[int]) -> None:
        """Work out transitions."""
        self._put(np.array(keys, np.int64), np.array([self._step(k >> 8, k & 255) for k in keys], np.int32))

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and emission."""
        grown, grow, more = [], self.vocabulary.grow, bytes((byte,))
        for tokens, last, rest in marshal.loads(self.readings[state]):
            rest += more
            before, token = grow(last, rest)
            if before is not None:
                grown.append((tokens, before, rest))
            if token is not None:
                grown.append(((*tokens, token), token, b""))
        first, agreed = grown[0][0], 0
        most = min([len(tokens) for tokens, _, _ in grown])
        while agreed < most and all([tokens[agreed] == first[agreed] for tokens, _, _ in grown]):
            agreed += 1
        target = self._state(sorted([(tokens[agreed:], last, rest) for tokens, last, rest in grown]))
        return target, self._emission(first[:agreed])

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all matches in order, and how many of them were emitted before each byte (one more at the end)."""
        emitted = np.zeros((len(data), 2), np.int32)  # at a byte, and by the end of a match after it
        longest_first = np.argsort(-lengths, kind="stable")
        at, lengths = starts[longest_first], lengths[longest_first]
        states = np.zeros(len(at), np.int64)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for step, lanes in enumerate(active.tolist()):
            if lanes < FEW_LANES:
                for lane in range(lanes):
                    states[lane] = self._run_one(data, int(at[lane]) + step, int(at[lane] + lengths[lane]), int(states[lane]), emitted)
                break
            place = at[:lanes] + step
            key = (states[:lanes] << 8) + data[place]
            slots = self._find(key)
            missing = np.flatnonzero(self.keys[slots] < 0)
            if len(missing):
                self.resolve(np.unique(key[missing]).tolist())
                slots = self._find(key)
            moved = self.values[slots]
            emitted[place, 0] = moved[:, 1]
            states[:lanes] = moved[:, 0]
        emitted[at + lengths - 1, 1] = np.array(self.end)[states]
        sizes, flat = np.array(self.sizes), np.array(self.tokens)
        used = emitted.ravel()
        counts = sizes[used]
        before = np.concatenate(([0], np.cumsum(counts)[1::2]))
        some = np.flatnonzero(counts)
        n = counts[some]
        offsets = np.repeat((np.cumsum(sizes) - sizes)[used[some]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return flat[offsets], before

    def _run_one(self, data: np.ndarray, at: int, stop: int, state: int, emitted: np.ndarray) -> int:
        known: dict[int, tuple[int, int]] = {}
        for place in range(at, stop):
            key = state << 8 | int(data[place])
            if key not in known:
                slot = self._find(np.array([key]))
                if self.keys[slot[0]] < 0:
                    self.resolve([key])
                    slot = self._find(np.array([key]))
                known[key] = tuple(self.values[slot[0]].tolist())
            state, emitted[place, 0] = known[key]
        return state


def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own pattern engine sees it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes((b,)): b for b in range(256)}
    classes = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        matched = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(matched.encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    classes[ord(BREAK)] = EDGE
    return classes


def match_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the matches of the splitting pattern start, for texts set off by ``BREAK`` on both sides."""
    kind = classes[points]
    new_run = np.empty(len(kind), bool)
    new_run[0], new_run[1:] = True, kind[1:] != kind[:-1]
    space = kind == SPACE
    starts = new_run & (kind != EDGE)
    after_blank = np.zeros(len(kind), bool)  # a blank belongs to the run that follows it
    after_blank[1:] = points[:-1] == 32
    starts &= space | ~after_blank
    last_space = space.copy()  # the last space of a run stands apart from those before it, unless the text ends
    last_space[:-1] &= ~space[1:] & (kind[1:] != EDGE)
    starts |= last_space
    quote = np.flatnonzero((points == 39) & starts)
    quote = quote[kind[quote + 1] == LETTER]
    one = points[quote + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    two = np.where(short, 0, points[np.minimum(quote + 2, len(points) - 1)])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, length in ((quote[short], 2), (quote[long], 3)):
        starts[found + 1] = False
        starts[found[kind[found + length] == LETTER] + length] = True
    return starts


class Encoder:
    """Whole texts to ids of a rank file."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)
        self.classes = character_classes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (little-endian uint32)."""
        if not texts:
            return []
        if len(self.transducer.readings) > MOST_STATES:
            self.transducer.clear()
        points = np.frombuffer((BREAK + BREAK.join(texts) + BREAK).encode("utf-32-le", "surrogatepass"), "<u4")
        starts = match_starts(points, self.classes)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        edges = points == ord(BREAK)
        width[edges] = 0
        byte_at = np.cumsum(width) - width
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = byte_at[starts]
        tokens, before = self.transducer.run(data, begin, np.diff(begin, append=len(data)))
        cuts = before[byte_at[edges]]
        return [tokens[a:b].astype("<u4") for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


class StreamDecoder:
    """Ids in portions to text, holding back the bytes of an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, ids: list[int]) -> str:
        vocabulary, held, out = self.vocabulary, self.held, []
        if not held:
            try:
                return "".join(map(vocabulary.characters.__getitem__, ids))
            except TypeError:  # a token that is no whole number of characters
                pass
        steps = vocabulary.steps
        for token in ids:
            step = steps.get((held, token))
            if step is None:
                step = steps[held, token] = utf8_step(held, vocabulary.bytes_of[token])
            text, held = step
            out.append(text)
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        """The rest: an unfinished character is replaced."""
        rest, self.held = REPLACED if self.held else "", b""
        return rest


def second_bytes(lead: int) -> tuple[int, int]:
    """Bounds of the byte after a lead byte: no overlong forms, no surrogates, nothing above U+10FFFF."""
    return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))


def utf8_step(held: bytes, more: bytes) -> tuple[str, bytes]:
    """Run the UTF-8 machine over ``more``, from the state that ``held`` stands for: text, and what is held then."""
    out: list[str] = []
    for byte in more:
        if held:
            low, high = second_bytes(held[0]) if len(held) == 1 else (0x80, 0xBF)
            if low <= byte <= high:
                held += bytes((byte,))
                if len(held) == (2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4):
                    out.append(held.decode())
                    held = b""
                continue
            out.append(REPLACED)
            held = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            held = bytes((byte,))
        else:
            out.append(REPLACED)
    return "".join(out), held


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decode(vocabulary: Vocabulary, ids: np.ndarray, portion: int = 256) -> str:
    """Text of a whole document, decoded in portions."""
    decoder = StreamDecoder(vocabulary)
    parts = [decoder.feed(ids[k:k + portion].tolist()) for k in range(0, len(ids), portion)]
    return "".join(parts) + decoder.finish()


def round_trip(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars``: one row per row of ``docs``, encoded and decoded again."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in text_slices(texts, SLICE_CHARS):
                tokens = enc.encode_all(texts[a:b])
                decoded = [decode(enc.vocabulary, t) for t in tokens]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:b], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in tokens]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    pa.array([len(t) for t in decoded], pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
