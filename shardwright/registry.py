"""Registered queries (one per operator of the inventory) and their SQL oracles.

Every query reads the driver tables of ``sf_dir`` whole (or data Spark derives
from them) and returns a DataFrame whose column names equal the oracle's.
Parameters shared by the queries and their SQL live at the top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills QUERIES / ORACLES
    from .plans import (q_batches, q_eval, q_geometry, q_index, q_runs, q_schedule,  # noqa: F401
                        q_labels, q_records, q_selection, q_sources, q_streaming, q_tokens)
