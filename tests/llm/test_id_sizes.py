"""Size of coded ids on real token streams."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from shardwright.llm.id_codec import decode_blocks, encode_blocks


def test_bytes_an_id_with_three_estimates_and_range_coded_literals():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([e.ids for e in tokenizer.encode_batch([t for t in texts if t], add_special_tokens=False)])
    rows = ids[:len(ids) // 1024 * 1024].reshape(-1, 1024)
    blocks = encode_blocks(rows, 49_408)
    assert (decode_blocks(blocks, 1024, 49_408) == rows).all()
    assert sum(map(len, blocks)) < 1.49 * rows.size
