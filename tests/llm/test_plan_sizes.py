"""No plan holds several steps of an iteration: the driver's memory for planning grows with the square of a plan."""

import pytest

from shardwright.llm import components, exact_dedup, mixing, ngram_join

EDGES = [(k, k + 1) for k in range(1, 9)]
TEXTS = [(k, f"a b c d e f g {k // 2}", "ab"[k % 2]) for k in range(12)]


def joins_and_aggregates(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join ") + plan.count("Aggregate ")


@pytest.fixture
def written(monkeypatch):
    """Joins and aggregates of every table that the operators write."""
    sizes = []
    for module in (components, exact_dedup, mixing, ngram_join):
        def noted(df, name, stage=module.stage):
            sizes.append((joins_and_aggregates(df), name))
            return stage(df, name)
        monkeypatch.setattr(module, "stage", noted)
    return sizes


def test_components_write_each_half_of_a_round(spark, written):
    out = components.components(spark.createDataFrame(EDGES, "a long, b long"), "a", "b")
    assert sorted(map(tuple, out.collect())) == [(k, 1) for k in range(2, 10)]
    assert max(written)[0] <= 5


def test_newton_writes_each_step(spark, written):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    out = mixing.entropy_mix(docs)
    assert out.count() == len(TEXTS)
    assert max(w for w in written if w[1] == "dual")[0] <= 2
    assert max(w for w in written if w[1] == "copies-closed")[0] <= 1


def test_exact_dedup_writes_each_level(spark, written):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    out = exact_dedup.exact_dedup(docs)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()) == \
        [(k, k - k % 2, 2) for k in range(12)]
    assert max(written)[0] <= 1
    assert joins_and_aggregates(out) <= 4


def test_ngram_join_plans_its_blocks_alone(spark, written):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    out = ngram_join.jaccard_join(docs)
    assert out.count() == len(TEXTS)
    assert "blocks" in [name for _, name in written]
    assert max(w for w in written if w[1] == "edges")[0] <= 5
