"""The transducer against the tokenizer library, the streaming decoder against Python's own."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import awkward_rows, table

from shardwright.llm import bpe_fst

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["'s", "'t", "'re", "'ll", "'", "  ", " ", "\n", "\t", "a", "b", "st", "Ze", "é", "日", "本", "😀", "1", "²", "-", "!!",
          "...", " ", "　", "l", "'ve", "x'", "́", "aaaa", "0000", "  \n", "\x1c", "<|endoftext|>"]


def library(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def wanted():
    return library(RANKS)


@pytest.fixture(scope="module")
def own():
    return bpe_fst.Encoder(RANKS)


def test_encodes_as_the_library(own, wanted):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)]))
                      for _ in range(50)) for _ in range(500)]
    texts += ["", "a" * 30_000, " " * 3000, "ab" * 2000, "!" * 999, "日" * 700, "é" * 100, "'s" * 50, "".join(PIECES) * 400]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == wanted.encode_ordinary(text)
        assert bpe_fst.decode(own.vocabulary, ids) == text


def test_another_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [r[1] or "" for r in awkward_rows()]
    assert [t.tolist() for t in bpe_fst.Encoder(path).encode_all(texts)] == library(path).encode_ordinary_batch(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_texts(own, wanted, texts):
    assert [t.tolist() for t in own.encode_all(texts)] == [wanted.encode_ordinary(t) for t in texts]


def test_dropped_tables_change_nothing(wanted, monkeypatch):
    monkeypatch.setattr(bpe_fst, "MOST_STATES", 5)
    monkeypatch.setattr(bpe_fst, "MOST_CACHED", 5)
    small = bpe_fst.Encoder(RANKS)
    for row in awkward_rows():
        assert small.encode_all([row[1] or ""])[0].tolist() == wanted.encode_ordinary(row[1] or "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=30), st.integers(1, 7))
def test_decodes_any_ids_in_any_portions(own, ids, portion):
    raw = b"".join(own.vocabulary.bytes_of[i] for i in ids)
    assert bpe_fst.decode(own.vocabulary, np.array(ids, int), portion) == raw.decode("utf-8", "replace")


def test_decoder_holds_back_unfinished_characters(own):
    decoder = bpe_fst.StreamDecoder(own.vocabulary)
    ids = [own.vocabulary.ranks[bytes((b,))] for b in "é😀".encode()]
    assert [decoder.feed([i]) for i in ids] == ["", "é", "", "", "", "😀"] and decoder.finish() == ""
    assert decoder.feed(ids[:1]) == "" and decoder.finish() == "�"


def test_whole_table(docs, rows, wanted):
    expected = []
    for doc_id, text, *_ in rows:
        ids = wanted.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    got = table(bpe_fst.round_trip(docs, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(expected, key=repr)


def test_empty_table(no_docs):
    assert bpe_fst.round_trip(no_docs, RANKS).collect() == []
