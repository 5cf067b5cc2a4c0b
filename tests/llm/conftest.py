"""Small documents with every awkward case: nulls, empties, ties, repeats, long texts, clashing columns."""

import pytest
from llm_helpers import awkward_rows
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside or return
CLASHING = ["row", "id", "n", "node", "size", "kept", "score", "owner", "cid", "run", "copies", "component_id", "bucket"]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit(f"other {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
