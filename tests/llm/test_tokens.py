"""Packing, token-id files and their coder: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardwright.llm import best_fit, id_codec, id_files
from shardwright.llm.token_ids import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


ODD = ["", " ", "\n", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "a\tb c", "\na b", "a b\n", "it's we'll don't", "x <|endoftext|> y",
       "tok<|endoftext|>x", "İstanbul ñandú", "12 34!! 5,6", "¿qué? «oui»", "日本語 テスト。 a", "ΑΣ ΑΣ. Σ", "a\x1cb \x1c d", "ﬁn ª º ß ẞ",
       "a, b; c: d! e? f.", "foo&&& bar### \"q\" (x) [y] a_b", "....", "?! ?! .", "\r\n x\r\ny", "e\u0301 te\u0301st"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_cache_gives_the_library_ids(path):
    encoder, tokenizer = WordEncoder(path, max_words=20), Tokenizer.from_file(path)
    for texts in (ODD, ODD[::-1], ODD):  # the cache is full and cleared in between
        for text, raw in zip(texts, encoder.encode_all(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


_encoders = {p: (WordEncoder(p), Tokenizer.from_file(p)) for p in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'sT.,;!#1 \n\t\u00a0日ſ<|>_-"), max_size=40))
def test_word_cache_on_any_text(text):
    for encoder, tokenizer in _encoders.values():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit(docs, no_docs, rows):
    out = best_fit.best_fit(docs, BYTE).collect()
    tokenizer, places, want = Tokenizer.from_file(BYTE), defaultdict(list), []
    for d, t, *_ in rows:
        ids = ids_of(tokenizer, t, 2)
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in out), key=repr) == sorted(want, key=repr)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        stops = [a + n for a, n in sorted(place)]
        assert [a for a, _ in sorted(place)] == [0, *stops[:-1]] and stops[-1] <= 1024
    least = -(-sum(r["length"] for r in out) // 1024)
    assert len(places) <= least * 1.05 + 2
    assert best_fit.best_fit(no_docs, BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_open_bins_are_bounded_and_never_overfull(lengths, most):
    bins, fill = best_fit.OpenBins(64, most), defaultdict(int)
    for n in lengths:
        number, offset = bins.put(n)
        assert offset == fill[number]
        fill[number] += n
        assert fill[number] <= 64 and bins.n_open <= most


def test_id_files(docs, no_docs, rows):
    got = table(id_files.write_and_read(docs, WORD, 49_408), "doc_id", "start", "n_tokens", "ids_crc32")
    tokenizer, want, at = Tokenizer.from_file(WORD), [], 0
    for d, t in sorted(((d, t) for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, t, 1)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(want, key=repr) == got
    assert id_files.write_and_read(no_docs, WORD, 49_408).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 300), st.integers(1, 70_000), st.integers(0, 1 << 30), st.booleans())
def test_codec_round_trip(lanes, length, below, seed, skewed):
    rnd = np.random.default_rng(seed)
    ids = rnd.integers(0, below, (lanes, length))
    if skewed:
        ids = np.minimum(rnd.zipf(1.5, (lanes, length)), below) - 1
    payloads = id_codec.encode_blocks(ids, below)
    assert (id_codec.decode_blocks(payloads, length, below) == ids).all()
    one = lanes // 2  # a block can be read without the others
    assert (id_codec.decode_blocks([payloads[one]], length, below)[0] == ids[one]).all()


def test_repetitive_ids_get_small():
    ids = np.tile(np.arange(50), (4, 40))
    assert sum(map(len, id_codec.encode_blocks(ids, 49_408))) < ids.size * 2 / 5


def test_damaged_files_are_refused():
    builder, ids = id_files.FileBuilder(100), np.arange(5000, dtype="<u4") % 97
    builder.add(3, ids.tobytes())
    builder.add(None, b"")
    builder.add(9, ids[:10].tobytes())
    content = builder.content()
    assert [(d, at, len(raw) // 4) for d, at, raw in id_files.documents_of(content)] == [(3, 0, 5000), (None, 5000, 0), (9, 5000, 10)]
    for at in (0, 20, 40, len(content) - 5):
        broken = bytearray(content)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            list(id_files.documents_of(bytes(broken), "file"))
    with pytest.raises(ValueError):
        list(id_files.documents_of(content[:-1], "file"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_letters_go_to_the_model_alone(name):
    """New words of ASCII letters do not take the whole way of the library, and their ids are the same."""
    texts = ["The brownish foxes\nJumped over, the Brownish fence.", "brownish FOXES jumped\nover naïve fences, twice"]
    enc, whole = WordEncoder(public_tokenizers.path(name)), []
    ids = enc._ids
    enc._ids = lambda text: (whole.append(text), ids(text))[1]
    raw = enc.encode_all(texts)
    assert not any("rown" in text or "umped" in text for text in whole)
    assert any("na" in text for text in whole)
    assert [np.frombuffer(r, "<u4").tolist() for r in raw] == [ids(t) for t in texts]


def test_latin_texts_are_cut_into_pieces_and_each_is_learnt_once():
    """Latin-1 texts of the word vocabulary do not go word by word; pieces met before are not learnt again."""
    enc, tokenizer = WordEncoder(WORD), Tokenizer.from_file(WORD)
    texts = ["The déjà vu, the DÉJÀ vu; it's (the) 12 ½²!?", "l'eau d'été 'S's 'rex 'vexed '", "", "vu\x85the\xa0the"]
    learnt, learn = [], enc._learn_pieces
    enc._learn_pieces = lambda pieces: (learnt.extend(pieces), learn(pieces))[1]
    for _ in range(2):
        got = [np.frombuffer(raw, "<u4").tolist() for raw in enc.encode_all(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(learnt) == len(set(learnt)) and b"the" in learnt and b"The" not in learnt
    assert not enc.cache  # the words of the other way
    assert not WordEncoder(BYTE).latin


_pieces = (WordEncoder(WORD), WordEncoder(WORD, max_words=5))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("'stmdrevll <|>")), max_size=30), max_size=4))
def test_pieces_of_any_latin_text(texts):
    tokenizer = _encoders[WORD][1]
    for enc in _pieces:
        assert [np.frombuffer(raw, "<u4").tolist() for raw in enc.encode_all(texts)] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_damaged_blocks_decode_to_something():
    """Any bytes can be decoded without an error of their own; the checksum of a block then tells."""
    rnd = np.random.default_rng(5)
    for below in (2, 300, 49_408):
        for size in (0, 6, 9, 400):
            got = id_codec.decode_blocks([rnd.bytes(size), b"\xff" * size], 64, below)
            assert got.shape == (2, 64)
