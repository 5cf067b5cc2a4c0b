"""Training-data pipeline over ``documents``: five of the ten operators in a row.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame; ``run`` writes each stage's rows as Parquet and
reads them back as the next one's ``docs``.  All but the last return the columns
of ``documents``.

1. quality: documents that the compression classifier rejects go.
2. exact dedup: of equal texts the smallest doc_id stays.
3. n-gram Jaccard join: of each group of linked documents the smallest doc_id stays.
4. mixing: each document is repeated as often as the mix takes it, or left out.
5. best-fit packing: the pieces of all documents and their places in sequences.

Decisions come back to the documents by row number, so rows that share an id,
or have none, are kept or dropped one by one.  A row's number is its place in the
Parquet files of ``docs``, which every reading agrees on.  An empty input gives
empty results in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwright.llm import best_fit, exact_dedup, mixing, ngram_join, quality
from shardwright.llm.scratch import read_columns, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "__row"
ROWS_A_FILE = 36  # bits of the row number within a file


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with their place in the files they are read from: the same at every reading, however the files are split.

    The number is the file's rank among the paths and the row's index in the file, so
    no copy of the documents is written for it.
    """
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    names = placed.select("__file").distinct()
    ranks = stage(names.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).alias("__rank")), "files")
    number = F.shiftleft(F.col("__rank").cast("long"), ROWS_A_FILE) + F.col("__index")
    return placed.join(ranks, "__file").select(*COLUMNS, number.alias(ROW))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), read_columns(spark, sf_dir, "labels", "doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows, row_col=ROW).filter("kept").select(ROW)
    return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    linked = stage(ngram_join.jaccard_join(rows, row_col=ROW), "linked")
    alone = linked.filter("n_shingles = 0 OR component_id IS NULL").select(ROW)
    first = linked.filter("n_shingles > 0 AND doc_id = component_id").groupBy("component_id").agg(F.min(ROW).alias(ROW))
    return rows.join(alone.unionByName(first.select(ROW)), ROW, "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    taken = mixing.entropy_mix(rows, row_col=ROW).filter("copies > 0").select(ROW, "copies")
    return rows.join(taken, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# the classifier's dictionaries and the packing order have no SQL form; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read_columns(spark, sf_dir, "documents", *COLUMNS)
    for number, (_, apply) in enumerate(STAGES):
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
