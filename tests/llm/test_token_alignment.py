"""The alignment against a plain one over the libraries' own tokens."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import table
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shardwright.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> and <s>x</s>", "a ▁ b", " lead", "tail ", "a  b\n\n c\t", "日本語😀é", "\x00", "x" * 5000, "a", "　", "ﬁne",
       "don't stop", "<0x41> <unk>", "é́ combining", "\r\n", "Zürich 12345 ½"]


def plain(rows):
    """The contract's columns, by sets of end offsets and plain loops."""
    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = token_alignment.byte_of_character()
    a_bytes = {i: bytes(byte[c] for c in t) if set(t) <= set(byte) else t.encode()
               for t, i in json.load(open(A))["model"]["vocab"].items()}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            b_raw = [bytes((int(b_tok.id_to_piece(i)[3:5], 16),)) if b_tok.is_byte(i)
                     else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            a_raw, whole = [a_bytes[i] for i in a], (" " + text).encode()
            if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
                a = b = []
        if not a:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        links = [(x, y) for x, e in zip(a, a_end) for y, f in zip(b, b_end) if e == f] if len(a) < 300 else \
            [(x, b[b_end.index(e)]) for x, e in zip(a, a_end) if e in set(b_end)]
        cuts = sorted(set(a_end) & set(b_end))
        groups = ";".join(",".join(str(x) for x, e in zip(a, a_end) if lo < e <= hi) + "|"
                          + ",".join(str(x) for x, e in zip(b, b_end) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts))
        counts.update(links)
        docs.append((doc_id, len(a), len(b), links, groups))
    best = defaultdict(int)
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, na, nb, len(set(g.split(";"))) and g.count(";") + 1 if g else 0, len(links),
                    sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, links, g in docs), key=repr)


@pytest.mark.parametrize("block_chars", [50, 3_000, 2_000_000])
def test_whole_table(spark, docs, rows, block_chars):
    short = [(i, t) for i, t, *_ in rows if len(t or "") < 20_000]
    frame = docs.filter("text IS NULL OR length(text) < 20000")
    got = table(token_alignment.align_and_count(frame, A, B, block_chars=block_chars), *COLUMNS)
    assert got == plain(short)


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table(token_alignment.align_and_count(frame, A, B, block_chars=30), *COLUMNS) == plain(rows)


def test_lanes_change_nothing(rows, monkeypatch):
    both, texts = token_alignment.Tokenizers(A, B), [t or "" for _, t, *_ in rows] + ODD
    whole = token_alignment.align_block(both, texts)
    for size in (1, 7, 1_000_000):
        monkeypatch.setattr(token_alignment, "LANE_BYTES", size)
        cut = token_alignment.align_block(both, texts)
        assert all(np.array_equal(getattr(whole, f), getattr(cut, f)) for f in whole.__dataclass_fields__)


def test_lockstep_finds_equal_ends():
    rnd = random.Random(2)
    for _ in range(200):
        size = rnd.randrange(1, 60)
        a, b = (sorted({*rnd.sample(range(1, size + 1), rnd.randrange(size)), size}) for _ in range(2))
        stops = sorted({*rnd.sample(range(1, size + 1), rnd.randrange(min(size, 5))), size})
        x, y = token_alignment.lockstep(np.array(a), np.array(b), np.array(stops))
        assert [e for e, k in zip(a, x) if k] == [e for e, k in zip(b, y) if k] == sorted(set(a) & set(b))


def test_real_outputs(spark):
    row = token_alignment.align(spark.createDataFrame([(1, "don't stop"), (2, None)], "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    both = token_alignment.Tokenizers(A, B)
    ends = np.cumsum(both.a_lengths[row[0].a_ids]).tolist()
    assert [ends[k] for k in row[0].a_cuts] == row[0].cut_bytes and row[0].cut_bytes[-1] == len(" don't stop")
    assert np.cumsum(both.b_lengths[row[0].b_ids])[row[0].b_cuts].tolist() == row[0].cut_bytes
    assert row[1].a_ids == row[1].b_ids == row[1].cut_bytes == []


def test_empty_table(no_docs):
    assert token_alignment.align_and_count(no_docs, A, B).collect() == []
