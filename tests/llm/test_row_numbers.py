"""The stages of the pipeline when the files of ``docs`` are split otherwise at a later reading."""

import corpus_pipeline as cp
import pytest

from shardwright.llm.scratch import stage

SPLIT = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
OPERATORS = {1: (cp.exact_dedup, "exact_dedup"), 2: (cp.ngram_join, "jaccard_join"), 3: (cp.mixing, "entropy_mix")}


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select(*cp.COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("number", OPERATORS)
def test_rows_kept_do_not_depend_on_file_splits(spark, docs, monkeypatch, number):
    apply = cp.STAGES[number][1]
    start = stage(docs.select(*cp.COLUMNS).repartition(3), "start")
    want = as_rows(apply(spark, start, ""))
    module, name = OPERATORS[number]
    operator = getattr(module, name)
    usual = {key: spark.conf.get(key) for key in SPLIT}

    def other_splits_from_here(*args, **kwargs):
        out = stage(operator(*args, **kwargs), "decided")
        for key, value in SPLIT.items():
            spark.conf.set(key, value)
        return out

    monkeypatch.setattr(module, name, other_splits_from_here)
    try:
        assert as_rows(apply(spark, start, "")) == want
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
