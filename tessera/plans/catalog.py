"""Registry of the queries exposed through ``__spark_entry__``.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables; where SQL can express it, a DuckDB oracle text with the same column
names sits next to it. Queries are grouped by module below (text, labels,
splits, features, evaluation, explanation, models).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (q_text, q_labels, q_splits, q_features, q_eval,  # noqa: F401
                   q_explain, q_models, q_embed)
