"""Seeded pseudo-random keys from md5, identical in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_key(*parts) -> Column:
    """md5 of the parts joined by '-' (strings or columns)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


def hex_int(md5_col: Column, digits: int = 4) -> Column:
    """First ``digits`` hex characters of an md5 as an integer."""
    return F.conv(F.substring(md5_col, 1, digits), 16, 10).cast("int")
