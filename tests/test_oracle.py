"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as ent

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
SQLS = ent.oracle_sql()
QUERIES = ent.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small_dir, t + '.parquet')}')")
    return c


def test_every_query_has_oracle_or_reason():
    assert set(SQLS) <= set(QUERIES)
    assert len(SQLS) >= 60


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, small_dir, con, name):
    df = QUERIES[name](spark, small_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(SQLS[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, got) == _rows(cols, res.fetchall())


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0
