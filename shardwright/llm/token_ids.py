"""Whole texts to ids by the ``tokenizers`` library, with a cache of its words.

A byte-pair tokenizer never merges across the pieces its pre-tokenizer cuts,
so the ids of a text are the ids of its space-separated words one after the
other, wherever the cut is sure to be one of the pre-tokenizer's own: a single
space with no white space beside it.  Each worker keeps the library's ids of
the words it has met (a bounded cache; clearing it changes no result).  A
single line break between two words is a sure cut as well.  Texts whose white
space is irregular are cut only at the sure single spaces, without the cache.
A word of ASCII letters is one piece that a pre-tokenizer leaves as it is, so the
library's model merges it directly; other words take the whole way.

A vocabulary without leading spaces whose pre-tokenizer is ``LATIN_PIECES`` needs
no words for Latin-1 texts: there the pre-tokenizer's pieces are found on arrays
of character classes, one byte a character, Arrow numbers the distinct ones of
a slice, and only these are looked up.  Other texts are cut into words as above.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

ID = np.dtype("<u4")
SURE_CUT = re.compile(r"(?<=\S) (?=\S)")
# punctuation that the pre-tokenizers cut off a word of letters in one piece (an apostrophe may start a contraction)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PROBES = (*CAPITALS, *CAPITALS.lower(), "word", "Word", "WORDS", "xQzjWkq", "internationalisation", "\nword", "\nWordXq")
ENDING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# the normalizer and pattern whose pieces are found on arrays of character classes
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_NORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPACE, LETTER, NUMBER, OTHER = range(4)
LATIN = [chr(c) for c in range(256)]
LATIN_CLASS = bytes(SPACE if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
                    for c in LATIN)
LATIN_LOWER = "".join(LATIN).lower().encode("latin-1")
LATIN_SPACE = bytes(c for c in range(256) if LATIN_CLASS[c] == SPACE)


class WordEncoder:
    """``encode(text)`` gives the ids of a whole text as little-endian uint32 bytes.

    ``spaced`` tells whether a leading space belongs to a word (byte-level
    vocabularies) or is dropped by the pre-tokenizer.  A cached word stands for
    itself after a space, or, written with a line break in front, after that
    line break.
    """

    def __init__(self, path: str, max_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced = bool(self._ids(" "))
        self.max_words = max_words
        self.cache: dict[str, bytes] = {}
        self.newline = self._bytes("\n")
        self.folds = all(self._ids(c) == self._ids(c.lower()) for c in CAPITALS)
        self.space = "\u0120" if self.spaced else ""  # a space in byte-level vocabularies
        # an added token of letters would be cut out of words, and a pre-tokenizer of another kind may change them
        added = [t.content.strip() for t in self.tok.get_added_tokens_decoder().values()]
        self.direct = not any(t.isascii() and t.isalpha() for t in added) and \
            self._direct(list(PROBES)) == [self._one(w) for w in PROBES]
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.latin = not self.spaced and self._cuts_latin_pieces()
        if self.latin:
            self._forget_pieces()
        if not self.spaced:
            vocabulary = self.tok.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), ID).tobytes()

    def _after_break(self, word: str) -> bytes:
        return self.newline + self._bytes(word[1:])

    def _one(self, word: str) -> bytes:
        return self._after_break(word) if word[0] == "\n" else self._bytes(" " + word if self.spaced else word)

    def _cuts_latin_pieces(self) -> bool:
        """Whether normalizer and pre-tokenizer are those whose pieces are found on arrays."""
        if not self.tok.normalizer or not self.tok.pre_tokenizer:
            return False
        norm, cut = (json.loads(part.__getstate__()) for part in (self.tok.normalizer, self.tok.pre_tokenizer))
        return norm.get("normalizers") == LATIN_NORM and cut.get("pretokenizers") == [
            {"type": "Split", "pattern": {"Regex": LATIN_PIECES}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

    def _direct(self, words: list[str]) -> list[bytes]:
        """Ids of words of ASCII letters, from the library's model."""
        merge, out = self.tok.model.tokenize, []
        for first in range(0, len(words), 4096):
            some = words[first:first + 4096]
            pieces = [w[1:] if w[0] == "\n" else self.space + w for w in some]
            ids = [[t.id for t in merge(w.lower() if self.folds else w)] for w in pieces]
            raw, at = np.fromiter(chain.from_iterable(ids), ID).tobytes(), 0
            for w, own in zip(some, ids):
                stop = at + 4 * len(own)
                out.append(self.newline + raw[at:stop] if w[0] == "\n" else raw[at:stop])
                at = stop
        return out

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, in one call of the library."""
        if self.spaced:  # every word is followed by one line break, which is one id
            ids = np.array(self._ids("".join(w[1:] + "\n" if w[0] == "\n" else " " + w + "\n" for w in words)), ID)
            ends = np.flatnonzero(ids == np.frombuffer(self.newline, ID)[0])
            starts, lead = np.concatenate(([0], ends[:-1] + 1)), self.newline
        else:
            ids = np.array(self._ids(" ".join(words)), ID)
            ends = np.flatnonzero(self.closes[ids]) + 1
            starts, lead = np.concatenate(([0], ends[:-1])), b""
        if len(ends) != len(words):
            return [self._one(w) for w in words]
        raw = ids.tobytes()
        return [(lead if w[0] == "\n" else b"") + raw[4 * a:4 * b]
                for w, a, b in zip(words, starts.tolist(), ends.tolist())]

    def _learn(self, words: set[str]) -> None:
        """Cache the ids of new words; letters go to the library together, without their punctuation."""
        cache, plain, later = self.cache, {}, []
        for w in words:
            core = w.rstrip(ENDING)
            bare = core[1:] if core[:1] == "\n" else core
            if bare.isalpha() and (bare.isascii() or max(bare) < "\u0100"):
                if core not in cache:
                    plain[core] = None
                if len(core) < len(w):
                    later.append((w, core, w[len(core):]))
            else:
                cache[w] = self._one(w)
        if self.direct:
            letters = [w for w in plain if w.isascii()]
            cache.update(zip(letters, self._direct(letters)))
            plain = [w for w in plain if not w.isascii()]
        if plain:
            cores = list(plain)
            cache.update(zip(cores, self._plain(cores)))
        tails = {t: self._bytes(t) for t in {t for _, _, t in later}}
        for w, core, tail in later:
            cache[w] = cache[core] + tails[tail]

    def _regular(self, word: str) -> bool:
        """Whether a part is a word with white space only inside, or one line break in front of such a word."""
        bare = word[1:] if word[:1] == "\n" else word
        return bool(bare) and len(bare.strip()) == len(bare)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts; unknown words of all of them are learnt together."""
        if not self.latin:
            return self._by_words(texts)
        out, plain, places = [b""] * len(texts), [], []
        others = []
        for k, t in enumerate(texts):
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                others.append(k)
                continue
            if "<" in t and any(a in t for a in self.added):
                others.append(k)
            else:
                plain.append(raw)
                places.append(k)
        for some, ids in ((places, self._by_pieces(plain)), (others, self._by_words([texts[k] for k in others]))):
            for k, raw in zip(some, ids):
                out[k] = raw
        return out

    def _by_pieces(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts without added tokens."""
        if len(self.pieces) > self.max_words:
            self._forget_pieces()
        # a space after each text, and room to look ahead
        data = (b" ".join(texts) + b"   ").translate(LATIN_LOWER)
        points = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(LATIN_CLASS), np.uint8)
        new = kind == NUMBER
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        quote = np.flatnonzero(points == 39)
        quote = quote[new[quote] & (kind[quote + 1] == LETTER)]  # such a piece is the quote alone, but for contractions
        one, two = points[quote + 1], points[quote + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, length in ((quote[short], 2), (quote[long], 3)):
            new[found + 1] = False
            new[found + length] |= kind[found + length] == LETTER
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=len(data))
        inked = np.flatnonzero(kind[starts] != SPACE)  # white space between pieces is left out
        starts, ends = starts[inked], np.concatenate(([0], np.cumsum(lengths[inked])))
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(ends), pa.py_buffer(data.translate(None, LATIN_SPACE))]).dictionary_encode()
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        new_pieces = [w for w in distinct if w not in self.pieces]
        if new_pieces:
            self._learn_pieces(new_pieces)
        numbers = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))
        known = pa.Array.from_buffers(pa.large_binary(), len(self.pieces), [
            None, pa.py_buffer(self.piece_ends), pa.py_buffer(self.piece_ids)])
        ids = known.take(pa.array(numbers[cut.indices.to_numpy()]))
        _, offsets, raw = ids.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(ids) + 1)
        stops = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        stops = offsets[np.searchsorted(starts, stops)].tolist()
        raw = memoryview(raw) if raw else b""
        return [bytes(raw[a:b]) for a, b in zip([0, *stops], stops)]

    def _forget_pieces(self) -> None:
        self.pieces: dict[bytes, int] = {}  # their numbers; the ids of all, one after the other, and where each one's end
        self.piece_ids, self.piece_ends = b"", np.zeros(1, np.int64)

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        """Number new pieces and keep their ids; letters go to the library together."""
        words = [p.decode("latin-1") for p in pieces]
        letters = [w for w in words if w.isalpha()]
        direct = [w for w in letters if w.isascii()] if self.direct else []
        plain = [w for w in letters if not w.isascii()] if self.direct else letters
        known = dict(zip(direct, self._direct(direct)))
        if plain:
            known.update(zip(plain, self._plain(plain)))
        ids = [known[w] if w in known else self._bytes(w) for w in words]
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces))))
        ends = np.cumsum([len(raw) for raw in ids], dtype=np.int64) + self.piece_ends[-1]
        self.piece_ids, self.piece_ends = b"".join([self.piece_ids, *ids]), np.concatenate((self.piece_ends, ends))

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts, cut into words at their spaces."""
        cache = self.cache
        if len(cache) > self.max_words:
            cache.clear()
        # where the vocabulary has no capitals, a word in either case is one word of the cache
        parts = [(t.lower() if self.folds and t.isascii() else t).replace("\n", " \n").split(" ") for t in texts]
        words: set[str] = set()
        for p in parts:
            p[0] = "\n" + p[0]  # as after a line break, whose ids are taken off again
            words.update(p)
        words = words.difference(cache)
        odd = {w for w in words if not self._regular(w)}
        self._learn(words - odd)
        get, out = cache.__getitem__, []
        for text, p in zip(texts, parts):
            if odd and not odd.isdisjoint(p):
                cut = SURE_CUT.split(text)
                out.append(b"".join([self._bytes(cut[0])] + [self._bytes(" " + w) for w in cut[1:]]))
            else:
                out.append(b"".join(map(get, p))[len(self.newline):])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_slices(texts: list[str], most_chars: int = 2_000_000):
    """Consecutive slices of ``texts`` of about ``most_chars`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
