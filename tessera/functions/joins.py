"""Joins whose hot keys go another way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(table: DataFrame, count_col: str, shares: int, total: int) -> DataFrame:
    """The rows of ``table`` whose key stands in at least a ``shares``-th of all ``total`` rows that
    will meet them: at most ``shares`` rows, as their counts add up to ``total`` at most."""
    return table.where(F.col(count_col) * shares >= F.lit(max(total, shares)))


def heavy_join(rows: DataFrame, table: DataFrame, on: Sequence[str], heavy: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` (one row per key). The keys of ``heavy``, a bounded part of the
    table, are broadcast and their rows do not move; only the others are shuffled. ``rows`` is
    read twice, so it should be written or cheap."""
    on = list(on)
    few = F.broadcast(heavy)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(table, on))
