"""Spans and slices cut from shard files, against the chunk join and plain slices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardwright.functions.encoders import text_slices
from shardwright.operators import packing as pk
from shardwright.operators import span_cursor as cursor
from shardwright.operators import spans as sp
from shardwright.operators import tokens as tk
from shardwright.sources import token_bin as tb

TEXTS = ["Hello", "", "wörld 😀", None, "x" * 50, "é", "tail of the corpus"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Shard files of 16 tokens each, and the whole token stream."""
    folder = str(tmp_path_factory.mktemp("shards") / "bin")
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_ord long, text string").repartition(3)
    parts = tk.packed_parts(corpus.fillna({"text": ""}), 16)
    tb.write_shards(parts, folder)
    return folder, [t for x in TEXTS for t in [50256, *(x or "").encode()]]


def stem(k):
    return f"fineweb_{'train' if k else 'val'}_{k:06d}"


def test_packed_parts_are_the_stream(spark, stored):
    folder, stream = stored
    rows = tb.read_shards(spark, folder + "/*.bin").collect()
    got = {r["shard_stem"]: list(r["tokens"]) for r in rows}
    assert got == {stem(k // 16): stream[k:k + 16] for k in range(0, len(stream), 16)}


def test_texts_meet_their_offsets_before_they_are_packed(spark):
    """Of the two exchanges of the corpus only the one by shard moves packed ids; other columns go along with them."""
    corpus = spark.createDataFrame([(0, "a"), (0, "bc"), (1, None), (2, "d")], "doc_ord long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tk.packed_parts(corpus, 16)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    made, joined = (next(k for k, line in enumerate(plan) if name in line) for name in ("MapInArrow", "SortMergeJoin"))
    assert made < joined  # the join lies below
    rows = tk.pack_documents(corpus.withColumn("at", F.length("text"))).collect()
    assert sorted((r["doc_ord"], r["at"], np.frombuffer(r["packed"], "<u2").tolist()) for r in rows if r["doc_ord"] != 1) == [
        (0, 1, [50256, 97]), (0, 2, [50256, 98, 99]), (2, 1, [50256, 100])]
    assert [(r["at"], np.frombuffer(r["packed"], "<u2").tolist()) for r in rows if r["doc_ord"] == 1] == [(None, [50256])]


def test_any_encoder(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "abc"), (1, "")], "doc_ord long, text string")
    tb.write_shards(tk.packed_parts(corpus, 100, lambda t: [1000 + ord(c) for c in t]), str(tmp_path / "bin"))
    assert np.fromfile(f"{tmp_path}/bin/{stem(0)}.bin", "<u2")[512:].tolist() == [50256, 1097, 1098, 1099, 50256]
    with pytest.raises(Exception, match="16 bits"):
        tk.pack_documents(corpus, lambda t: [70_000]).collect()


@pytest.mark.parametrize("ahead, region", [(1, 1), (5, 8), (1 << 18, 1 << 22)])
def test_spans(spark, stored, monkeypatch, ahead, region):
    folder, stream = stored
    monkeypatch.setattr(cursor, "REGION", region)
    monkeypatch.setattr(cursor, "AHEAD", ahead)
    rows = [(stem(k), a, b, f"{k}-{a}-{b}") for k in range(5) for a in range(0, 16, 3) for b in range(a, 17, 4)]
    spans = spark.createDataFrame(rows, "shard_stem string, start_idx long, end_idx long, name string")
    got = {r["name"]: list(r["tokens"]) for r in cursor.span_tokens(spans, folder, skip_delimiter=False).collect()}
    assert got == {name: stream[16 * int(s[-6:]) + a:16 * int(s[-6:]) + b] for s, a, b, name in rows}
    skipped = {r["name"]: list(r["tokens"]) for r in cursor.span_tokens(spans, folder).collect()}
    assert skipped == {name: tokens[1:] for name, tokens in got.items()}


def test_text_is_never_altered(spark, stored):
    folder, stream = stored
    rows = [(stem(0), 0, 6), (stem(0), 0, 7), (stem(0), 6, 7), (stem(0), 7, 10), (stem(0), 7, 11)]
    texts = cursor.decode_spans(spark.createDataFrame(rows, "shard_stem string, start_idx long, end_idx long"), folder)
    got = {(r["start_idx"], r["end_idx"]): r["text"] for r in texts.collect()}
    # a span with a delimiter inside, or cut inside a character, has no text
    assert got == {(0, 6): "Hello", (0, 7): None, (6, 7): "", (7, 10): None, (7, 11): "wö"}


def test_spans_beyond_a_shard_are_refused(spark, stored):
    spans = spark.createDataFrame([(stem(0), 10, 17)], "shard_stem string, start_idx long, end_idx long")
    with pytest.raises(Exception, match="ends at 16"):
        cursor.span_tokens(spans, stored[0]).collect()


def test_slices_as_by_the_chunk_join(spark, stored):
    folder, stream = stored
    plan = spark.createDataFrame([(0, 0, 0, stem(1), 0, 2, 9), (0, 0, 0, stem(1), 1, 11, 14), (0, 0, 1, stem(2), 0, 0, 10)],
                                 "step long, micro int, rank int, shard_stem string, piece int, start_idx long, end_idx long")
    rows = [(stem(k // 16), (k % 16) // 4, k % 16, stream[k:k + 4]) for k in range(0, len(stream), 4)]
    chunks = spark.createDataFrame(rows, "shard_stem string, chunk_id int, start_pos long, tokens array<int>")
    joined = sp.span_tokens(plan, chunks, skip_delimiter=False, key_cols=["step", "micro", "rank", "piece"], chunk_size=4)
    wanted = {}
    for r in joined.orderBy("rank", "piece").collect():
        wanted.setdefault(r["rank"], []).extend(r["tokens"])
    assert {r["rank"]: list(r["buf"]) for r in cursor.slice_buffers(plan, folder).collect()} == wanted
    hashed = spark.createDataFrame([(k, v[:-1]) for k, v in wanted.items()], "rank int, inputs array<int>")
    by_column = {r["rank"]: list(r["h"]) for r in hashed.select("rank", pk.bigram_hash(F.col("inputs")).alias("h")).collect()}
    assert {r["rank"]: list(r["h"]) for r in cursor.slice_hashes(plan, folder).collect()} == by_column
    sums = {r["rank"]: (r["n"], r["hash_sum"], r["hash_weighted"], r["hash_max"]) for r in cursor.slice_hash_sums(plan, folder).collect()}
    assert sums == {k: (len(h), sum(h), sum(i * x for i, x in enumerate(h)), max(h)) for k, h in by_column.items()}


def test_no_token_array_is_exchanged(spark, stored):
    spans = spark.createDataFrame([(stem(0), 0, 5)], "shard_stem string, start_idx long, end_idx long")
    plan = cursor.span_tokens(spans, stored[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "tokens" not in plan[plan.index("Exchange"):]


def test_what_is_held_is_bounded():
    """Slices of texts by their bytes; cut tokens and a writer's ids keep no read or batch alive."""
    texts = pa.array(["abc", None, "é" * 40, "", "xy", "z" * 9] * 50).slice(1)
    slices = list(text_slices(texts, 10))
    assert [(first, n) for first, n, _, _ in slices][0] == (0, 1) and sum(n for _, n, _, _ in slices) == len(texts)
    assert all(len(raw) <= 10 or n == 1 for _, n, _, raw in slices)
    joined = [raw[a:b].tobytes().decode() for _, _, rel, raw in slices for a, b in zip(rel, rel[1:])]
    assert joined == [t or "" for t in texts.to_pylist()]
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_cut_tokens_keep_no_read_alive(stored):
    tokens = cursor.ShardCursor(stored[0], None, 16).tokens(stem(0), 2, 4)
    assert tokens.flags.owndata and tokens.tolist() == stored[1][2:4]
    assert len(cursor.ShardCursor(stored[0], None, 0).tokens(stem(0), 2, 4)) == 2


def test_dealt_spans_stay_where_they_are(spark, stored):
    rows = [(stem(k % 5), k % 3, 9 + k % 3, k) for k in (7, 3, 9, 1, 4)]
    spans = spark.createDataFrame(rows, "shard_stem string, start_idx long, end_idx long, k int").coalesce(1)
    got = [(r["k"], np.frombuffer(r["packed"], "<u2").tolist()) for r in cursor.packed_spans(spans, stored[0], dealt=True).collect()]
    assert got == [(k, stored[1][16 * int(s[-6:]) + a:16 * int(s[-6:]) + b]) for s, a, b, k in rows]
