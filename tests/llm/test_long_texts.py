"""The quality classifier on texts of many pieces."""

import random

from pyspark.sql import functions as F

from shardwright.llm import quality

SF = "/root/testdata/sf0.01"


def test_pieces_cover_the_whole_text():
    for n in (0, 1, quality.PIECE_BYTES, quality.PIECE_BYTES + 1, 5 * quality.PIECE_BYTES + 3):
        text = random.Random(n).randbytes(n)
        parts = quality.pieces(text)
        assert b"".join(parts) == text and max(map(len, parts)) <= quality.PIECE_BYTES
        assert max(map(len, parts)) - min(map(len, parts)) <= 1


def test_held_out_accuracy_on_long_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(*quality.training_sample(docs, labels, "doc_id", "text", "quality"))
    seen = docs.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).select("quality", "text").collect()
    rnd, made = random.Random(5), []
    for label in (0, 1):
        pool = sorted(r["text"] for r in seen if r["quality"] == label and r["text"])
        for size in (30_000, 400_000, 400_000, 1_000_000):
            text = ""
            while len(text) < size:
                text += rnd.choice(pool) + "\n"
            made.append((label, size, text))
    out = quality.score(spark.createDataFrame(made, "label int, size long, text string"), model, "text").collect()
    assert [(r["label"], r["size"], r["score"]) for r in out if (r["score"] >= 0.5) != r["label"]] == []
